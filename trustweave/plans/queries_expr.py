"""Queries over expressions: predicates, relations, aggregates, paths and derivations."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustweave.expr import Agg, Compare, EdgeDerivation, FilteredRelation, GroupBy, Literal, RecursiveTraversal, RelationAggregate, RelationRef, path
from trustweave.plans.binding import LINES, ORDERS, PART_SUPPLIERS, graph
from trustweave.plans.lowering import OWNER
from trustweave.plans.registry import query


def _part(name: str) -> object:
    return path("Part", name)


def _predicate(name: str, condition, where: str) -> None:
    """A query for the parts, or orders, that a predicate keeps."""

    @query(name, f"SELECT p_partkey AS part_id FROM part WHERE {where}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return graph(spark, sf_dir).where("Part", condition).select("part_id")


_predicate("pred_compare", (_part("size") > 10) & (_part("size") <= 20) & (_part("price") != 1000.0), "p_size > 10 AND p_size <= 20 AND p_retailprice <> 1000.0")
_predicate("pred_in", _part("size").isin([1, 5, 9, 40]), "p_size IN (1, 5, 9, 40)")
_predicate("pred_not_in", _part("size").not_in([1, 5, 9]), "p_size NOT IN (1, 5, 9)")
_predicate("pred_within", _part("brand").within(["Brand#11", "Brand#22", "Brand#33"]), "p_brand IN ('Brand#11', 'Brand#22', 'Brand#33')")
_predicate("pred_between", _part("size").between(10, 20), "p_size BETWEEN 10 AND 20")
_predicate("pred_between_exclusive", _part("size").between(10, 20, inclusive=False), "p_size > 10 AND p_size < 20")
_predicate("pred_like", _part("type").matches("%A%"), "p_type LIKE '%A%'")
_predicate("pred_regex", _part("brand").matches("^Brand#[12]"), "regexp_matches(p_brand, '^Brand#[12]')")
_predicate("pred_affix", _part("brand").starts_with("Brand#1") | _part("brand").ends_with("5"), "starts_with(p_brand, 'Brand#1') OR ends_with(p_brand, '5')")
_predicate("pred_null", Compare("is not null", _part("name")), "p_name IS NOT NULL")
_predicate("pred_bool", ~((_part("size") < 5) | (_part("size") > 45)), "NOT (p_size < 5 OR p_size > 45)")


@query("pred_datetime", "SELECT o_orderkey AS order_id, o_totalprice AS total FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'")
def pred_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = path("Order", "ordered")
    when = (day >= datetime.datetime(1996, 1, 1)) & (day < datetime.datetime(1997, 1, 1))
    return graph(spark, sf_dir).where("Order", when).select("order_id", "total")


@query("rel_project", "SELECT o_custkey AS owner, o_orderkey AS order_id, o_totalprice AS total FROM orders JOIN customer ON c_custkey = o_custkey")
def rel_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).relation(ORDERS.select("order_id", "total"), "Customer").withColumnRenamed(OWNER, "owner")


@query("rel_filtered", "SELECT o_custkey AS owner, o_orderkey AS order_id FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'")
def rel_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter over a filter."""
    relation = ORDERS.where(path("Order", "total") > 100000).where(path("Order", "status") == "F")
    return graph(spark, sf_dir).relation(relation.select("order_id"), "Customer").withColumnRenamed(OWNER, "owner")


@query("rel_forward", "SELECT o_orderkey AS owner, c_name AS name FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 5000")
def rel_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A foreign key of the owner: each order's customer."""
    relation = FilteredRelation(RelationRef("Order", "customer"), path("Customer", "acctbal") > 5000)
    return graph(spark, sf_dir).relation(relation.select("name"), "Order").withColumnRenamed(OWNER, "owner")


@query("rel_scan", "SELECT n_nationkey AS nation_id, n_name AS name FROM nation WHERE n_regionkey = 1")
def rel_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trustweave.expr import Scan

    return graph(spark, sf_dir).relation(FilteredRelation(Scan("Nation"), path("Nation", "region") == 1).select("nation_id", "name"), "Nation")


@query("rel_count", "SELECT c_custkey AS customer_id, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def rel_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners without rows have 0."""
    return graph(spark, sf_dir).select("Customer", {"customer_id": path("Customer", "customer_id"), "n": ORDERS.count()})


@query("rel_count_distinct", "SELECT c_custkey AS customer_id, count(DISTINCT o_orderpriority) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def rel_count_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).select("Customer", {"customer_id": path("Customer", "customer_id"), "n": ORDERS.select("priority").count(distinct=True)})


@query(
    "rel_agg",
    """
    SELECT c_custkey AS customer_id, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 6) AS mean, min(o_totalprice) AS least, max(o_totalprice) AS most,
        count(o_orderkey) AS n, count(DISTINCT o_orderstatus) AS kinds, round(sum(DISTINCT round(o_totalprice, -3)), 2) AS rounded
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey
    """,
)
def rel_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    g.frames["Order"] = g.frames["Order"].withColumn("rounded", F.round("total", -3))
    derived = {
        "customer_id": path("Customer", "customer_id"), "total": ORDERS.agg("sum", "total"), "mean": ORDERS.agg("avg", "total"), "least": ORDERS.agg("min", "total"),
        "most": ORDERS.agg("max", "total"), "n": ORDERS.agg("count", "order_id"), "kinds": ORDERS.agg("count", "status", distinct=True), "rounded": ORDERS.agg("sum", "rounded", distinct=True),
    }
    return g.select("Customer", derived).withColumns({c: F.round(c, n) for c, n in (("total", 2), ("mean", 6), ("rounded", 2))})


@query(
    "rel_collect",
    """
    SELECT o_orderkey AS order_id, string_agg(CAST(l_quantity AS INTEGER), ',' ORDER BY l_quantity) AS quantities,
        string_agg(l_linestatus, '' ORDER BY l_shipdate, l_linestatus) AS by_day
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey
    """,
)
def rel_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = {"order_id": path("Order", "order_id"), "q": LINES.collect("quantity"), "d": LINES.collect("linestatus", order_by="shipped")}
    joined = graph(spark, sf_dir).select("Order", lists)
    quantities = F.array_join(F.transform("q", lambda x: x.cast("int").cast("string")), ",")
    return joined.select("order_id", quantities.alias("quantities"), F.array_join("d", "").alias("by_day"))


@query("rel_agg_first", "SELECT o_orderkey AS order_id, arg_min(l_linestatus, row(l_shipdate, l_linestatus)) AS first_status FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def rel_agg_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).select("Order", {"order_id": path("Order", "order_id"), "first_status": LINES.agg("first", "linestatus", order_by="shipped")})


@query(
    "rel_first",
    "SELECT o_custkey AS owner, o_orderkey AS order_id, o_totalprice AS total FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1",
)
def rel_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph(spark, sf_dir).aggregate(ORDERS.first("ordered", "order_id"), "Customer")
    return rows.select(F.col(OWNER).alias("owner"), "value.order_id", "value.total")


@query("rel_any", "SELECT c_custkey AS customer_id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def rel_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).where("Customer", ORDERS.any_(path("Order", "total") > 300000)).select("customer_id")


@query("rel_none", "SELECT c_custkey AS customer_id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def rel_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).where("Customer", ~ORDERS.any_(path("Order", "status") == "P")).select("customer_id")


@query("rel_all", "SELECT c_custkey AS customer_id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND NOT coalesce(o_totalprice > 20000, false))")
def rel_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True where every row provably fulfils the condition, and where there is none."""
    return graph(spark, sf_dir).where("Customer", ORDERS.all_(path("Order", "total") > 20000)).select("customer_id")


@query("rel_empty", "SELECT c_custkey AS customer_id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def rel_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a condition it asks for no rows at all."""
    return graph(spark, sf_dir).where("Customer", ORDERS.where(path("Order", "total") > 250000).all_()).select("customer_id")


@query(
    "rel_predicates_mixed",
    """
    SELECT c_custkey AS customer_id FROM customer WHERE c_acctbal < 0 OR (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) >= 15
        OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)
    """,
)
def rel_predicates_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations within an OR become left joins of grouped rows."""
    condition = (path("Customer", "acctbal") < 0) | (ORDERS.count() >= 15) | ORDERS.any_(path("Order", "total") > 400000)
    return graph(spark, sf_dir).where("Customer", condition).select("customer_id")


@query("group_by_source", "SELECT l_partkey AS owner, l_returnflag AS source, round(sum(l_quantity), 2) AS total FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2")
def group_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = RelationRef("LineItem", "part").agg("sum", "quantity", group_by=GroupBy.SOURCE)
    return graph(spark, sf_dir).aggregate(n, "Part").select(F.col(OWNER).alias("owner"), "source", F.round("value", 2).alias("total"))


@query(
    "map_by_source",
    """
    SELECT owner, string_agg(source || '=' || q, ';' ORDER BY source) AS by_source
    FROM (SELECT l_partkey AS owner, l_returnflag AS source, string_agg(CAST(l_quantity AS INTEGER), ',' ORDER BY l_quantity) AS q FROM lineitem GROUP BY 1, 2) GROUP BY owner
    """,
)
def map_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph(spark, sf_dir).by_source(RelationRef("LineItem", "part").collect("quantity"), "Part")
    listed = F.transform(F.array_sort(F.map_entries("value")), lambda e: F.concat(e["key"], F.lit("="), F.array_join(F.transform(e["value"], lambda x: x.cast("int").cast("string")), ",")))
    return rows.select(F.col(OWNER).alias("owner"), F.array_join(listed, ";").alias("by_source"))


@query("pivot_source", "SELECT l_partkey AS owner, max(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS A, max(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS N, max(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS R FROM lineitem GROUP BY 1")
def pivot_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = RelationAggregate(RelationRef("LineItem", "part"), Agg.MAX, "quantity", pivot=("A", "N", "R"))
    return graph(spark, sf_dir).aggregate(n, "Part").withColumnRenamed(OWNER, "owner")


@query(
    "path_chain",
    "SELECT o_orderkey AS order_id, r_name AS region FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA' OR o_totalprice < 2000",
)
def path_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One left join for each hop."""
    region = path("Order", "customer", "nation", "region", "name")
    return graph(spark, sf_dir).select("Order", {"order_id": path("Order", "order_id"), "region": region}, (region == "ASIA") | (path("Order", "total") < 2000))


@query(
    "polymorphic_ref",
    """
    SELECT l_orderkey AS "order", coalesce(s_name, c_name) AS name, count(*) AS n FROM lineitem LEFT JOIN supplier ON s_suppkey = l_orderkey % 2000 LEFT JOIN customer ON c_custkey = l_orderkey % 2000
    GROUP BY ALL
    """,
)
def polymorphic_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first class that has the key counts."""
    rows = graph(spark, sf_dir).select("LineItem", {"order": path("LineItem", "order"), "name": path("LineItem", "either", "name")})
    return rows.groupBy("order", "name").agg(F.count("*").alias("n"))


@query(
    "discriminated_ref",
    """
    SELECT l_linenumber % 2 AS odd, CASE WHEN l_linenumber % 2 = 0 THEN c_name ELSE s_name END AS name, count(*) AS n
    FROM lineitem LEFT JOIN customer ON c_custkey = l_suppkey LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL
    """,
)
def discriminated_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key's class stands in another slot."""
    rows = graph(spark, sf_dir).select("LineItem", {"kind": path("LineItem", "owner_class"), "name": path("LineItem", "owner", "name")})
    return rows.groupBy(F.when(F.col("kind") == "Customer", 0).otherwise(1).alias("odd"), "name").agg(F.count("*").alias("n"))


@query("subclass_union", "SELECT 'Customer' AS class_name, c_name AS name, c_acctbal AS acctbal FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT 'Supplier', s_name, s_acctbal FROM supplier WHERE s_acctbal > 9000")
def subclass_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query of an abstract class returns its descendants."""
    return graph(spark, sf_dir).where("Party", path("Party", "acctbal") > 9000).select("class_name", "name", "acctbal")


@query("derived_edges", "SELECT DISTINCT l_partkey AS src_id, l_suppkey AS dst_id FROM lineitem JOIN part ON p_partkey = l_partkey")
def derived_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).edges("Part", PART_SUPPLIERS)


@query("derived_edges_filtered", "SELECT DISTINCT o_custkey AS src_id, l_partkey AS dst_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 49")
def derived_edges_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that are composed: customers to parts, over their orders' lines."""
    g = graph(spark, sf_dir)
    orders = g.edges("Customer", EdgeDerivation(ORDERS))
    parts = g.edges("Order", EdgeDerivation(LINES.where(path("LineItem", "quantity") > 49), "part"))
    joined = orders.withColumnRenamed("dst_id", "via").join(parts.withColumnRenamed("src_id", "via"), "via")
    return joined.select("src_id", "dst_id").distinct()


@query(
    "edge_closure",
    """
    WITH RECURSIVE step AS (SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b FROM nation WHERE n_nationkey % 4 <> 0),
    walk(src_id, dst_id, depth) AS (SELECT a, b, 1 FROM step UNION ALL SELECT src_id, b, depth + 1 FROM walk JOIN step ON a = dst_id WHERE depth < 4)
    SELECT src_id, dst_id, min(depth) AS depth FROM walk GROUP BY ALL
    """,
)
def edge_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything reached in up to four steps of a relation from a class to itself."""
    from trustweave.model import OntologyClass, Slot, Spec
    from trustweave.plans.lowering import Graph

    spec = Spec((OntologyClass("Node", (Slot("node_id", "integer", identifier=True), Slot("next", "Node"))),))
    nation = graph(spark, sf_dir).frame("Nation").select(F.col("nation_id").alias("node_id"))
    rows = nation.withColumn("next", F.when(F.col("node_id") % 4 != 0, (F.col("node_id") * 7 + 3) % 25))
    # Rows of Node whose "next" is the owner belong to it, so the relation is read against the arrow.
    return Graph(spec, {"Node": rows}).closure("Node", RecursiveTraversal(RelationRef("Node", "next"), 4)).select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"), "depth")


@query("format_derivation", "SELECT p_partkey AS part_id, coalesce(p_name, '') || ' (' || coalesce(p_brand, '') || ', size ' || coalesce(CAST(p_size AS VARCHAR), '') || ')' AS label FROM part")
def format_derivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).select("Part", {"part_id": path("Part", "part_id"), "label": path("Part", "label")})


@query("scalar_derivation", "SELECT p_partkey AS part_id, p_retailprice / p_size AS unit, p_retailprice * 1.1 + p_size - 2 AS adjusted FROM part WHERE p_retailprice / p_size > 100")
def scalar_derivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    adjusted = path("Part", "price") * 1.1 + path("Part", "size") - 2
    return graph(spark, sf_dir).select("Part", {"part_id": path("Part", "part_id"), "unit": path("Part", "unit"), "adjusted": adjusted}, path("Part", "unit") > Literal(100))


@query("include_rows", "SELECT n_nationkey AS nation_id, n_name AS name, s_suppkey AS supplier_id, s_name AS supplier_name FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey")
def include_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row beside each of its related rows."""
    rows = graph(spark, sf_dir).include_rows("Nation", RelationRef("Supplier", "nation").select("supplier_id", "name"), "supplier")
    return rows.select("nation_id", "name", F.col("supplier_supplier_id").alias("supplier_id"), "supplier_name")


@query(
    "include_collect",
    """
    SELECT c_custkey AS customer_id, r_name AS region, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS orders
    FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL
    """,
)
def include_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each customer, with a slot over two hops and a list over a relation."""
    rows = graph(spark, sf_dir).include("Customer", {"region": path("Customer", "nation", "region", "name")}, {"orders": ORDERS.collect("order_id")})
    return rows.select("customer_id", "region", F.array_join(F.transform("orders", lambda x: x.cast("string")), ",").alias("orders"))


@query("order_limit", "SELECT o_orderkey AS order_id, o_totalprice AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def order_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the top 20."""
    return graph(spark, sf_dir).frame("Order").orderBy(F.col("total").desc_nulls_last(), "order_id").limit(20).select("order_id", "total")


@query("adhoc_sql", "SELECT l_returnflag AS source, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1")
def adhoc_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL over a view."""
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").createOrReplaceTempView("lines")
    return spark.sql("SELECT l_returnflag AS source, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM lines GROUP BY 1")
