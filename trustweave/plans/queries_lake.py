"""Queries whose rows go through files: what is written by a sink is read back by a source."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustweave.expr import path
from trustweave.functions import text
from trustweave.model import Source, Spec
from trustweave.operators import normalize as N
from trustweave.operators import quality as Q
from trustweave.operators import resolution as R
from trustweave.plans import plugins
from trustweave.plans.binding import SPEC, graph, table
from trustweave.plans.registry import query
from trustweave.sources import lake
from trustweave.sources.shared import scratch


@query("csv_round_trip", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as CSV and back, by a schema."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    folder = scratch(spark)
    lake.export_csv(rows, f"{folder}/customer.csv")
    return lake.read_csv(spark, f"{folder}/customer.csv", rows.schema)


@query("csv_as_text", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def csv_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a schema all cells are texts; a source found as CSV where there is no Parquet."""
    folder = scratch(spark)
    lake.export_csv(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), f"{folder}/nation.csv")
    return lake.find_source(spark, folder, "nation")


@query("glob_scan", "SELECT r_regionkey AS id, r_name AS name, NULL::INTEGER AS region FROM region UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation")
def glob_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several files under one pattern, united by name."""
    folder = scratch(spark)
    table(spark, sf_dir, "region").selectExpr("int(r_regionkey) AS id", "r_name AS name").write.parquet(f"{folder}/a.parquet")
    table(spark, sf_dir, "nation").selectExpr("int(n_regionkey) AS region", "n_name AS name", "int(n_nationkey) AS id").write.parquet(f"{folder}/b.parquet")
    return lake.read_parquet(spark, f"{folder}/*.parquet").select("id", "name", "region")


@query("hive_layout", "SELECT l_returnflag AS source, count(*) AS n, sum(l_linenumber) AS total FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1")
def hive_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table in folders by source: a filter on the source reads only its folders."""
    store = lake.Lake(spark, scratch(spark))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("source"), "l_linenumber")
    store.write(rows.repartition("source"), "facts/line", codec="zstd", partition_by=("source",))
    return store.read("facts/line").where("source <> 'N'").groupBy("source").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("total"))


@query("lake_versions", "SELECT p_partkey, p_size * 3 AS p_size FROM part")
def lake_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is written three times, in other compressions, is its last version."""
    store = lake.Lake(spark, scratch(spark))
    rows = table(spark, sf_dir, "part")
    for n, codec in enumerate(("snappy", "gzip", "lz4"), 1):
        store.write(rows.select("p_partkey", (F.col("p_size") * n).alias("p_size")), "part", codec)
    return store.read("part")


@query("mounted_views", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def mounted_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder's files as views, read by a query over their names."""
    folder = scratch(spark)
    names = {name: f"v_{name}_{uuid.uuid4().hex}" for name in ("nation", "region")}
    for name, view in names.items():
        table(spark, sf_dir, name).write.parquet(f"{folder}/{view}.parquet")
    mounted = lake.mount(spark, folder)
    made = spark.sql(f"SELECT n_name, r_name FROM {names['nation']} JOIN {names['region']} ON n_regionkey = r_regionkey")
    for view in mounted:
        lake.drop_view(spark, view)
    return made


@query("context_rows", "SELECT c_custkey AS customer_id, c_mktsegment AS segment FROM customer WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING'")
def context_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a plug-in reads: rows by a condition, slots by name."""
    where = (path("Customer", "acctbal") > 0) & (path("Customer", "segment") == "BUILDING")
    return plugins.fulfil(graph(spark, sf_dir), plugins.DataContext("Customer", where, ("customer_id", "segment")))["Customer"]


@query(
    "identifier_pattern",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'Customer' ELSE 'Supplier' END AS entity_class, CAST(coalesce(c_custkey, s_suppkey) AS VARCHAR) AS entity_key
    FROM lineitem LEFT JOIN customer ON l_linenumber % 2 = 0 AND c_custkey = l_orderkey LEFT JOIN supplier ON l_linenumber % 2 = 1 AND s_suppkey = l_orderkey""",
)
def identifier_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that name an entity by its class and its key; many name one that isn't there."""
    spec = replace(SPEC, classes=tuple(replace(c, identifier_pattern=("owner_class", "owner")) if c.name == "LineItem" else c for c in SPEC.classes))
    g = graph(spark, sf_dir)
    kind = F.when(F.col("l_linenumber") % 2 == 0, "Customer").otherwise("Supplier")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", kind.alias("owner_class"), F.col("l_orderkey").alias("owner"))
    found = R.identified(spec, "LineItem", lines, {c: g.frame(c) for c in ("Customer", "Supplier")})
    return found.select("l_orderkey", "l_linenumber", "entity_class", "entity_key")


@query("json_length", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey % 5 + 1 END AS n FROM customer")
def json_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of JSON arrays in texts; nulls and other texts have none."""
    array = F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("["), F.expr("repeat('{\"a\": [1, 2]}, ', int(c_custkey % 5))"), F.lit("0]"))).when(F.col("c_custkey") % 2 == 0, '{"a": 1}')
    return table(spark, sf_dir, "customer").select("c_custkey", text.json_length(array).alias("n"))


@query("missing_identifier", "SELECT CAST(n_regionkey AS VARCHAR) AS src_key, n_name AS name FROM nation WHERE n_regionkey > 1")
def missing_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without an identifier are dropped where the source says so."""
    source = Source("S", "Nation", "key", mapping={"nation_id": "key", "name": "n_name"}, on_missing_identifier="drop")
    rows = table(spark, sf_dir, "nation").select(F.when(F.col("n_regionkey") > 1, F.col("n_regionkey")).alias("key"), "n_name")
    made = N.normalize(Spec(SPEC.classes, (source,), SPEC.types), source, rows)
    return made.facts["Nation"].select("src_key", "name")


@query("severity_gate", "SELECT 'Nation' AS class_name, count(*) AS n FROM nation WHERE n_nationkey < 5")
def severity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offenders of a rule that only warns don't block; those of an error do."""
    rows = table(spark, sf_dir, "nation").where("n_nationkey < 5")
    found = Q.offenders(rows, "few", "Nation", None, "n_nationkey", F.lit("below five"))
    Q.gate({"Nation": ("warning", found)})
    try:
        Q.gate({"Nation": (Q.ERROR, found)})
    except Q.BlockedPublish:
        return found.groupBy("class_name").agg(F.count("*").alias("n"))
    return spark.createDataFrame([], T.StructType([T.StructField("class_name", T.StringType()), T.StructField("n", T.LongType())]))
