"""The bundled tables as an ontology: its model, its entities and the contributions to its parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustweave.expr import EdgeDerivation, FormatDerivation, RelationRef, ScalarDerivation, path
from trustweave.model import DirectRef, DiscriminatedRef, OntologyClass, Policy, PolymorphicRef, Slot, Source, Spec, TypeDef
from trustweave.operators import trust
from trustweave.plans.lowering import Graph

#: The three sources of parts and their weights.
TRUST = {"A": 0.91, "N": 0.62, "R": 0.48}

SPEC = Spec(
    types=(TypeDef("phrase", "string", r"^[^|]*$"),),
    classes=(
        OntologyClass("Region", (Slot("region_id", "integer", identifier=True), Slot("name", required=True))),
        OntologyClass("Nation", (Slot("nation_id", "integer", identifier=True), Slot("name", required=True), Slot("region", "Region"))),
        OntologyClass("Party", (Slot("name", "phrase", required=True), Slot("nation", "Nation"), Slot("acctbal", "float", minimum=-1000.0, maximum=10000.0)), abstract=True),
        OntologyClass("Customer", (Slot("customer_id", "integer", identifier=True), Slot("segment")), is_a="Party"),
        OntologyClass("Supplier", (Slot("supplier_id", "integer", identifier=True),), is_a="Party"),
        OntologyClass(
            "Part",
            (
                Slot("part_id", "integer", identifier=True), Slot("name"), Slot("brand"), Slot("type"), Slot("size", "integer"), Slot("price", "float"),
                Slot("quantity", "float", policy=Policy.MEDIAN_NUMERIC), Slot("discount", "float"), Slot("tax", "float", policy=Policy.LATEST_WATERMARK),
                Slot("linestatus", policy=Policy.MODE), Slot("label", derivation=FormatDerivation("{name} ({brand}, size {size})")),
                Slot("unit", "float", derivation=ScalarDerivation(path("Part", "price") / path("Part", "size"))),
            ),
        ),
        OntologyClass(
            "Order",
            (
                Slot("order_id", "integer", identifier=True), Slot("customer", "Customer", reference=DirectRef("Customer")),
                Slot("status", permissible=("O", "F", "P")), Slot("total", "float", minimum=0.0), Slot("ordered", "datetime"), Slot("priority"),
            ),
        ),
        OntologyClass(
            "LineItem",
            (
                Slot("line_id", identifier=True), Slot("order", "Order", reference=DirectRef("Order")), Slot("part", "Part"), Slot("supplier", "Supplier"),
                Slot("quantity", "float"), Slot("price", "float"), Slot("source"), Slot("shipped", "datetime"), Slot("linestatus"),
                Slot("owner_class"), Slot("owner", "integer", reference=DiscriminatedRef("owner_class", ("Customer", "Supplier"))),
                Slot("either", "integer", reference=PolymorphicRef(("Supplier", "Customer"))),
            ),
        ),
    ),
    sources=tuple(Source(name, "Part", "l_partkey", trust=weight, watermark="l_shipdate") for name, weight in TRUST.items()),
)

ORDERS = RelationRef("Order", "customer")
LINES = RelationRef("LineItem", "order")
PART_SUPPLIERS = EdgeDerivation(RelationRef("LineItem", "part"), "supplier")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as what three sources say about parts."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("canonical_id"), F.col("l_returnflag").alias("source"), F.col("l_shipdate").alias("asserted_at"),
        F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("l_linestatus").alias("linestatus"),
    )
    return trust.with_trust(rows, SPEC)


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    t = lambda name: table(spark, sf_dir, name)
    rename = lambda d, **names: d.select(*[F.col(old).alias(new) for new, old in names.items()])
    line = t("lineitem").withColumn("owner_class", F.when(F.col("l_linenumber") % 2 == 0, "Customer").otherwise("Supplier"))
    line = line.withColumn("line_id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    line = line.withColumn("either", F.col("l_orderkey") % 2000).withColumn("owner", F.col("l_suppkey"))
    frames = {
        "Region": rename(t("region"), region_id="r_regionkey", name="r_name"),
        "Nation": rename(t("nation"), nation_id="n_nationkey", name="n_name", region="n_regionkey"),
        "Customer": rename(t("customer"), customer_id="c_custkey", name="c_name", nation="c_nationkey", acctbal="c_acctbal", segment="c_mktsegment"),
        "Supplier": rename(t("supplier"), supplier_id="s_suppkey", name="s_name", nation="s_nationkey", acctbal="s_acctbal"),
        "Part": rename(t("part"), part_id="p_partkey", name="p_name", brand="p_brand", type="p_type", size="p_size", price="p_retailprice"),
        "Order": rename(t("orders"), order_id="o_orderkey", customer="o_custkey", status="o_orderstatus", total="o_totalprice", ordered="o_orderdate", priority="o_orderpriority"),
        "LineItem": rename(
            line, line_id="line_id", order="l_orderkey", part="l_partkey", supplier="l_suppkey", quantity="l_quantity", price="l_extendedprice",
            source="l_returnflag", shipped="l_shipdate", linestatus="l_linestatus", owner_class="owner_class", owner="owner", either="either",
        ),
    }
    return Graph(SPEC, frames, {"Part": contributions(spark, sf_dir)})
