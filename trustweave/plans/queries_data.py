"""Queries over whole steps: normalizing, resolving entities, checking, history and publishing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustweave.expr import RelationRef, path
from trustweave.functions import text
from trustweave.model import OntologyClass, Slot, Source, Spec
from trustweave.operators import graph as G
from trustweave.operators import normalize as N
from trustweave.operators import quality as Q
from trustweave.operators import resolution as R
from trustweave.operators import temporal as T
from trustweave.plans import lineage
from trustweave.plans.compiler import compile_spec
from trustweave.plans.binding import SPEC, contributions, graph, table
from trustweave.plans.queries_trust import ROWS
from trustweave.plans.registry import query
from trustweave.plans.stages import Build
from trustweave.sources.lake import Lake
from trustweave.sources.shared import shared_dir

EVENTS = Spec(
    classes=(
        OntologyClass("Purchase", (Slot("event_id", "integer", identifier=True), Slot("user", "integer"), Slot("value", "float", required=True))),
        OntologyClass("Visit", (Slot("event_id", "integer", identifier=True), Slot("user", "integer"), Slot("kind"))),
    ),
    sources=(
        Source(
            "web", "Purchase", "event_id", mapping={"user": "user_id", "kind": "event_type"}, watermark="ts", discriminator="event_type",
            routes={"purchase": "Purchase", "error": None, "*": "Visit"},
        ),
    ),
)


@query("normalize_text", "SELECT p_partkey AS part_id, lower(trim(p_name)) AS folded, replace(p_brand, '#', '-') AS brand, substr(lower(trim(p_name)), 1, 5) AS prefix FROM part")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White space, dashes and case, on texts that are made untidy first."""
    untidy = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("  "), F.regexp_replace("p_name", " ", "   "), F.lit(" ")).alias("n"), F.regexp_replace("p_brand", "#", "–").alias("b"))
    folded = text.fold(text.clean(F.col("n")))
    return untidy.select(F.col("p_partkey").alias("part_id"), folded.alias("folded"), text.hyphens(F.col("b")).alias("brand"), text.prefix(text.clean(F.col("n")), 5).alias("prefix"))


@query("normalize_list", "SELECT p_partkey AS part_id, len(list_filter(string_split(p_type || ' ', ' '), lambda x: x <> '')) AS n, string_split(p_type, ' ')[1] AS first FROM part")
def normalize_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A separated list, with an empty part at its end."""
    rows = table(spark, sf_dir, "part").select("p_partkey", text.parse_list(F.concat(F.regexp_replace("p_type", " ", " | "), F.lit("|"))).alias("l"))
    return rows.select(F.col("p_partkey").alias("part_id"), F.size("l").cast("long").alias("n"), F.get("l", F.lit(0)).alias("first"))


@query("normalize_dates", "SELECT o_orderkey AS order_id, strftime(o_orderdate, '%Y-%m-%d') AS day, year(o_orderdate) AS year FROM orders")
def normalize_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three ways to write a date."""
    day = F.col("o_orderdate")
    kind = F.col("o_orderkey") % 3
    written = F.when(kind == 0, F.date_format(day, "yyyy-MM-dd")).when(kind == 1, F.date_format(day, "MM/dd/yyyy")).otherwise(F.date_format(day, "MMM d yyyy"))
    parsed = text.parse_date(written)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.date_format(parsed, "yyyy-MM-dd").alias("day"), text.year_of(parsed).cast("long").alias("year"))


@query("normalize_source", "SELECT 'A' AS source, CAST(l_partkey AS VARCHAR) AS src_key, sha256('A|' || l_partkey) AS row_id, l_shipdate AS asserted_at, l_quantity AS quantity FROM lineitem WHERE l_returnflag = 'A'")
def normalize_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").withColumnRenamed("l_quantity", "quantity")
    facts = N.normalize(SPEC, SPEC.source("A"), rows).facts["Part"]
    return facts.select("source", "src_key", "row_id", "asserted_at", "quantity")


@query("discriminator_route", "SELECT 'Purchase' AS class_name, event_id, user_id AS user FROM events WHERE event_type = 'purchase' UNION ALL SELECT 'Visit', event_id, user_id FROM events WHERE event_type NOT IN ('purchase', 'error')")
def discriminator_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows go to a class by their type; one type is dropped."""
    facts = N.normalize(EVENTS, EVENTS.sources[0], table(spark, sf_dir, "events")).facts
    return Q.union_all([d.select(F.lit(c).alias("class_name"), "event_id", "user") for c, d in facts.items()])


@query("normalize_rejected", "SELECT 'web' AS source, 'Purchase' AS class_name, CAST(event_id AS VARCHAR) AS src_key, 'missing value' AS reason FROM events WHERE event_type = 'purchase' AND value < 1")
def normalize_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that lack a required value are set apart, with the reason."""
    rows = table(spark, sf_dir, "events").withColumn("value", F.when(F.col("value") >= 1, F.col("value")))
    return N.normalize(EVENTS, EVENTS.sources[0], rows).rejected


@query("union_by_name", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_mktsegment AS segment", "c_name AS name")
    return customers.unionByName(table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "s_name AS name"), allowMissingColumns=True)


@query("since_cursor", "SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-02 00:00:00'")
def since_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.since(table(spark, sf_dir, "events"), "ts", "2024-01-02 00:00:00").select("event_id", "ts")


# Entity resolution over all customers. Titles are their numbers from the last digit on, which begin in a thousand ways,
# and their segment; sources go by nation.

LEAST = 0.9
TITLES = f"""titles AS (
    SELECT c_custkey AS row_id, 's' || CAST(c_nationkey % 4 AS VARCHAR) AS source, reverse(substr(c_name, 10)) || ' ' || c_mktsegment AS title, CAST(c_custkey % 3 AS INTEGER) AS year FROM customer
), words AS (
    SELECT *, array_to_string(list_sort(string_split(lower(title), ' ')), ' ') AS s, substr(lower(title), 1, 3) AS block FROM titles
), scored AS (
    SELECT a.row_id AS a, b.row_id AS b, (1 - CAST(levenshtein(a.s, b.s) AS DOUBLE) / greatest(length(a.s), length(b.s))) * 0.7 + (1 - abs(a.year - b.year)) * (1 - 0.7) AS score
    FROM words a JOIN words b ON a.block = b.block AND a.row_id < b.row_id AND a.source <> b.source AND abs(a.year - b.year) <= 1
)"""


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS row_id", "concat('s', c_nationkey % 4) AS source", "concat(reverse(substring(c_name, 10)), ' ', c_mktsegment) AS title", "int(c_custkey % 3) AS year"
    )


def _scored(rows: DataFrame) -> DataFrame:
    return R.score_titles(rows, letters=3, least=LEAST)


@query("er_pairs", f"WITH {TITLES} SELECT a, b, round(score, 6) AS score FROM scored WHERE score >= {LEAST}")
def er_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(_titles(spark, sf_dir)).select("a", "b", F.round("score", 6).alias("score"))


@query(
    "er_clusters",
    f"""
    WITH RECURSIVE {TITLES}, links AS (SELECT a, b FROM scored WHERE score >= {LEAST} UNION SELECT b, a FROM scored WHERE score >= {LEAST}),
    reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
    SELECT row_id, least(row_id, coalesce((SELECT min(b) FROM reach WHERE reach.a = row_id), row_id)) AS cluster FROM titles
    """,
)
def er_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _titles(spark, sf_dir)
    return R.cluster(rows, R.decide(_scored(rows), LEAST))


@query(
    "er_decisions",
    f"""
    WITH {TITLES}, strong AS (SELECT a, b FROM scored WHERE score >= {LEAST}),
    merged AS (SELECT a, b FROM strong UNION SELECT 2 * c_custkey, 2 * c_custkey + 1 FROM customer WHERE c_custkey < 20)
    SELECT a, b FROM merged WHERE (a + b) % 5 <> 0
    """,
)
def er_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forced merges are added and forced splits taken away."""
    rows = _titles(spark, sf_dir)
    pairs = _scored(rows)
    merges = rows.where("row_id < 20").select((2 * F.col("row_id")).alias("a"), (2 * F.col("row_id") + 1).alias("b"))
    splits = pairs.select("a", "b").union(merges).where("(a + b) % 5 = 0")
    return R.decide(pairs, LEAST, merges, splits)


@query("er_links", "SELECT a.l_orderkey AS o, a.l_partkey AS p, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey AND a.l_linestatus = b.l_linestatus AND a.l_returnflag < b.l_returnflag GROUP BY ALL")
def er_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relation rows of different sources with equal keys and role, whatever its case."""
    role = F.when(F.col("l_returnflag") == "A", F.lower("l_linestatus")).otherwise(F.col("l_linestatus"))
    rows = table(spark, sf_dir, "lineitem").withColumn("k", F.monotonically_increasing_id()).select(
        F.concat_ws("|", F.lpad("l_orderkey", 9, "0"), "l_partkey", "l_returnflag", "k").alias("row_id"), F.col("l_returnflag").alias("source"),
        F.col("l_orderkey").alias("work"), F.col("l_partkey").alias("person"), role.alias("role"),
    )
    pairs = R.score_links(rows).select(F.split("a", "[|]").alias("a"))
    return pairs.groupBy(F.get("a", F.lit(0)).cast("long").alias("o"), F.get("a", F.lit(1)).cast("long").alias("p")).agg(F.count("*").alias("n"))


@query(
    "er_persons",
    """
    WITH r AS (SELECT c_custkey AS row_id, c_mktsegment AS source, reverse(substr(c_name, 10)) AS name, CAST(1950 + c_custkey % 7 AS VARCHAR) AS y, CASE WHEN c_custkey % 50 = 0 THEN 'Q' || (c_custkey // 200) END AS q FROM customer),
    sure AS (SELECT a.row_id AS a, b.row_id AS b, 1.0 AS score FROM r a JOIN r b ON a.q = b.q AND a.row_id < b.row_id AND a.source <> b.source),
    near AS (SELECT a.row_id AS a, b.row_id AS b, 1 - CAST(levenshtein(a.name, b.name) AS DOUBLE) / greatest(length(a.name), length(b.name)) AS score
        FROM r a JOIN r b ON substr(a.name, 1, 3) = substr(b.name, 1, 3) AND a.row_id < b.row_id AND a.source <> b.source AND abs(CAST(a.y AS INTEGER) - CAST(b.y AS INTEGER)) <= 1)
    SELECT a, b, round(max(score), 6) AS score FROM (SELECT * FROM sure UNION ALL SELECT * FROM near WHERE score >= 0.75) GROUP BY a, b
    """,
)
def er_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shared identifier is certain; else a like name and a near year of birth.

    Names are the customers' numbers from their last digit on: they begin in a thousand ways, where names begin in one.
    """
    rows = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS row_id", "c_mktsegment AS source", "reverse(substring(c_name, 10)) AS name", "string(1950 + c_custkey % 7) AS birthdate",
        "CASE WHEN c_custkey % 50 = 0 THEN concat('Q', c_custkey div 200) END AS wikidata_id",
    )
    return R.score_persons(rows, least=0.75).select("a", "b", F.round("score", 6).alias("score"))


@query(
    "er_reconcile",
    """
    WITH c AS (SELECT n_nationkey AS row_id, n_nationkey - n_nationkey % 3 AS cluster FROM nation),
    p AS (SELECT n_nationkey AS row_id, 'id' || CAST(n_nationkey // 4 AS INTEGER) AS cid FROM nation WHERE n_nationkey < 16),
    j AS (SELECT c.cluster, c.row_id, cid FROM c LEFT JOIN p USING (row_id)),
    per AS (SELECT cluster, list_sort(list_distinct(list(cid) FILTER (cid IS NOT NULL))) AS ids FROM j GROUP BY cluster),
    parts AS (SELECT cid, count(DISTINCT cluster) AS n FROM j WHERE cid IS NOT NULL GROUP BY cid)
    SELECT per.cluster, CASE WHEN ids IS NULL OR len(ids) = 0 THEN 'new' WHEN len(ids) > 1 THEN 'conflict' WHEN n > 1 THEN 'split' ELSE 'kept' END AS outcome
    FROM per LEFT JOIN parts ON len(ids) = 1 AND cid = ids[1]
    """,
)
def er_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    clusters = nation.selectExpr("n_nationkey AS row_id", "n_nationkey - n_nationkey % 3 AS cluster")
    prior = nation.where("n_nationkey < 16").selectExpr("n_nationkey AS row_id", "concat('id', n_nationkey div 4) AS canonical_id")
    return R.reconcile(clusters, prior).select("cluster", "outcome")


# Data quality


def _offenders(rule: str, cls: str, slot: str | None, pk: str, detail: str, source: str) -> str:
    name = "CAST(NULL AS VARCHAR)" if slot is None else f"'{slot}'"
    return f"SELECT '{rule}' AS rule_id, '{cls}' AS class_name, {name} AS slot_name, CAST({pk} AS VARCHAR) AS offending_pk, {detail} AS detail FROM {source}"


@query("dq_required", _offenders("required:Order.priority", "Order", "priority", "o_orderkey", "'required value is null'", "orders WHERE o_orderkey % 11 = 0"))
def dq_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = graph(spark, sf_dir).frame("Order").withColumn("priority", F.when(F.col("order_id") % 11 != 0, F.col("priority")))
    return Q.required(df, "Order", "priority", "order_id")


@query("dq_range", _offenders("range:Part.size", "Part", "size", "p_partkey", "CAST(p_size AS VARCHAR) || ' is outside 5..45'", "part WHERE p_size < 5 OR p_size > 45"))
def dq_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.in_range(graph(spark, sf_dir).frame("Part"), "Part", "size", "part_id", 5, 45)


@query("dq_enum", _offenders("enum:Order.status", "Order", "status", "o_orderkey", "o_orderstatus || ' is not permitted'", "orders WHERE o_orderstatus NOT IN ('O', 'F')"))
def dq_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.permitted(graph(spark, sf_dir).frame("Order"), "Order", "status", "order_id", ("O", "F"))


@query("dq_pattern", _offenders("pattern:Part.brand", "Part", "brand", "p_partkey", "p_brand || ' doesn''t match the pattern'", "part WHERE NOT regexp_matches(p_brand, '^Brand#[1-3]')"))
def dq_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.well_formed(graph(spark, sf_dir).frame("Part"), "Part", "brand", "part_id", "^Brand#[1-3]")


@query("dq_unique", _offenders("unique:LineItem.l_orderkey,l_linenumber", "LineItem", "l_orderkey,l_linenumber", "l_orderkey || '|' || l_linenumber", "CAST(n AS VARCHAR) || ' rows share this key'", "(SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) WHERE n > 1"))
def dq_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.unique(table(spark, sf_dir, "lineitem"), "LineItem", ("l_orderkey", "l_linenumber"))


@query("dq_referential", _offenders("referential:Order.customer", "Order", "customer", "o_orderkey", "'no target ' || o_custkey", "orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 3)"))
def dq_referential(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return Q.referential(g.frame("Order"), "Order", "customer", "order_id", g.frame("Customer").where("customer_id % 10 <> 3"), "customer_id")


@query("dq_violations", _offenders("must_hold", "Order", None, "o_orderkey", "'constraint violated'", "orders WHERE NOT coalesce(o_totalprice > 5000 OR o_orderstatus = 'F', false)"))
def dq_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.violations(graph(spark, sf_dir), "Order", "must_hold", (path("Order", "total") > 5000) | (path("Order", "status") == "F"))


@query("dq_offenders", _offenders("bad_if", "Customer", None, "c_custkey", "'offending condition holds'", "customer WHERE c_acctbal < 0 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"))
def dq_offenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.bad_rows(graph(spark, sf_dir), "Customer", "bad_if", (path("Customer", "acctbal") < 0) & RelationRef("Order", "customer").any_())


@query("dq_freshness", _offenders("freshness:Event", "Event", "ts", "event_type", "'latest is ' || strftime(m, '%Y-%m-%d %H:%M:%S')", "(SELECT event_type, max(ts) AS m FROM events WHERE event_type <> 'click' OR ts < TIMESTAMP '2024-01-10' GROUP BY 1) WHERE m < (SELECT max(ts) FROM events) - INTERVAL 1 DAY"))
def dq_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    now = T.cursor_of(events, "ts")
    return Q.freshness(events.where("event_type <> 'click' OR ts < TIMESTAMP_NTZ '2024-01-10'"), "Event", "event_type", "ts", now.isoformat(sep=" "), "1 DAY")


@query(
    "dq_cluster_outlier",
    "WITH s AS (SELECT CASE WHEN o_custkey % 100 = 1 THEN 1 ELSE o_custkey END AS id, count(*) AS n FROM orders GROUP BY 1), u AS (SELECT avg(n) AS m, stddev_samp(n) AS d FROM s) "
    + _offenders("cluster_size:Customer", "Customer", None, "id", "'cluster of ' || n", "s, u WHERE n >= 5 AND n >= m + 3 * d"),
)
def dq_cluster_outlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.when(F.col("o_custkey") % 100 == 1, F.lit(1)).otherwise(F.col("o_custkey")).alias("canonical_id"))
    return Q.cluster_outliers(rows, "Customer")


@query(
    "dq_degree_outlier",
    "WITH d AS (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT quantile_cont(n, 0.99) AS q FROM d) " + _offenders("degree:Customer", "Customer", None, "id", "'degree ' || n", "d, b WHERE n > q AND n >= 5"),
)
def dq_degree_outlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.degree_outliers(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src_id"), F.col("o_orderkey").alias("dst_id")), "Customer")


@query(
    "dq_cycle",
    """
    WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 3 + 1) % 25 AS b FROM nation),
    w(s, d, k) AS (SELECT a, b, 1 FROM e UNION ALL SELECT s, b, k + 1 FROM w JOIN e ON a = d WHERE k < (SELECT count(*) FROM nation)),
    f AS (SELECT s, min(k) AS k FROM w WHERE s = d GROUP BY s) """
    + _offenders("cycle:Nation", "Nation", None, "s", "'cycle of length ' || k", "f"),
)
def dq_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS src_id", "(n_nationkey * 3 + 1) % 25 AS dst_id")
    return Q.cycles(edges, "Nation")


@query("dq_null_trend", _offenders("null_trend:Event.value", "Event", "value", "'value'", "'null share rises by ' || round(s, 6) || ' a run'", "(SELECT regr_slope(x, r) AS s FROM (SELECT user_id % 4 AS r, avg(CASE WHEN event_id % 10 < user_id % 4 THEN 1.0 ELSE 0.0 END) AS x FROM events GROUP BY 1)) WHERE s > 0.01"))
def dq_null_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr("user_id % 4 AS run_no", "CASE WHEN event_id % 10 >= user_id % 4 THEN value END AS value")
    return Q.null_rate_trend(rows, "Event", "value")


@query(
    "dq_coverage_drop",
    "WITH c AS (SELECT event_type AS e, user_id % 3 AS r, count(*) AS n FROM events WHERE user_id % 3 <> 2 OR event_type <> 'view' OR event_id % 5 = 0 GROUP BY ALL), l AS (SELECT *, lag(n) OVER (PARTITION BY e ORDER BY r) AS b FROM c) "
    + _offenders("coverage:Event", "Event", None, "e", "'from ' || b || ' to ' || n || ' rows'", "l WHERE n < b * 0.5"),
)
def dq_coverage_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("user_id % 3 <> 2 OR event_type <> 'view' OR event_id % 5 = 0").selectExpr("event_type", "user_id % 3 AS run_no")
    return Q.coverage_drop(rows, "Event", "event_type")


@query("dq_validate", "SELECT 'range:Customer.acctbal' AS rule_id, count(*) AS n FROM customer WHERE c_acctbal < -1000 OR c_acctbal > 9500 HAVING count(*) > 0")
def dq_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All declared checks of a class at once, counted by rule."""
    from dataclasses import replace

    changed = tuple(replace(c, overrides={"acctbal": {"maximum": 9500.0}}) if c.name == "Customer" else c for c in SPEC.classes)
    g = graph(spark, sf_dir)
    g.spec = replace(SPEC, classes=changed)
    return Q.validate(g, "Customer").groupBy("rule_id").agg(F.count("*").alias("n"))


# History

LOG = "log AS (SELECT user_id, event_type, ts, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS b FROM events), kept AS (SELECT * FROM log WHERE b IS NULL OR b <> event_type), versions AS (SELECT user_id, event_type, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS valid_to FROM kept)"


@query("scd2_history", f"WITH {LOG} SELECT * FROM versions")
def scd2_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.history(table(spark, sf_dir, "events"), "user_id", "event_type", "ts")


@query("asof_binding", f"WITH {LOG} SELECT user_id, event_type FROM versions WHERE valid_from <= TIMESTAMP '2024-01-15' AND TIMESTAMP '2024-01-15' < coalesce(valid_to, TIMESTAMP '9999-12-31')")
def asof_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.as_of(scd2_history(spark, sf_dir), "2024-01-15 00:00:00").select("user_id", "event_type")


@query(
    "asof_join",
    f"WITH {LOG} SELECT o_orderkey, o_custkey % 500 AS user_id, (SELECT event_type FROM versions v WHERE v.user_id = o_custkey % 500 AND valid_from <= t AND (valid_to IS NULL OR t < valid_to)) AS event_type FROM (SELECT *, TIMESTAMP '2024-01-01' + to_hours(CAST(o_orderkey % 700 AS INTEGER)) AS t FROM orders)",
)
def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order beside the version of its user at that time."""
    moment = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, int(o_orderkey % 700))")
    orders = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 500).alias("user_id"), moment.alias("t"), "o_orderkey")
    return T.as_of_join(orders, scd2_history(spark, sf_dir), "user_id", "t").select("o_orderkey", "user_id", "event_type")


def _bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs: each nation bound to its region, then every third to another."""
    nation = table(spark, sf_dir, "nation")
    first = nation.selectExpr("n_nationkey AS row_id", "concat('r', n_regionkey) AS canonical_id")
    none = spark.createDataFrame([], "row_id int, canonical_id string, valid_from timestamp_ntz, valid_to timestamp_ntz, run_id string, change_type string")
    second = nation.where("n_nationkey <> 24").selectExpr("n_nationkey AS row_id", "CASE WHEN n_nationkey % 3 = 0 THEN concat('s', n_regionkey) ELSE concat('r', n_regionkey) END AS canonical_id")
    return T.update_bindings(T.update_bindings(none, first, "2024-01-01 00:00:00", "run1"), second, "2024-02-01 00:00:00", "run2")


@query(
    "scd2_bindings",
    """
    SELECT n_nationkey AS row_id, 'r' || n_regionkey AS canonical_id, TIMESTAMP '2024-01-01' AS valid_from,
        CASE WHEN n_nationkey % 3 = 0 OR n_nationkey = 24 THEN TIMESTAMP '2024-02-01' END AS valid_to, 'run1' AS run_id, 'new' AS change_type FROM nation
    UNION ALL SELECT n_nationkey, 's' || n_regionkey, TIMESTAMP '2024-02-01', NULL, 'run2', 'changed' FROM nation WHERE n_nationkey % 3 = 0 AND n_nationkey <> 24
    """,
)
def scd2_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bindings(spark, sf_dir)


@query("id_redirect", "SELECT DISTINCT 'r' || n_regionkey AS old_id, CASE WHEN n_nationkey % 3 = 0 THEN 's' ELSE 'r' END || n_regionkey AS current_id FROM nation WHERE n_nationkey <> 24 UNION SELECT 's' || n_regionkey, 's' || n_regionkey FROM nation WHERE n_nationkey % 3 = 0 AND n_nationkey <> 24")
def id_redirect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.redirects(_bindings(spark, sf_dir))


@query("id_lineage", "SELECT DISTINCT 'r' || n_regionkey AS old_id, CASE WHEN n_nationkey % 3 = 0 THEN 's' ELSE 'r' END || n_regionkey AS new_id, 'split' AS kind FROM nation")
def id_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    old = nation.selectExpr("n_nationkey AS row_id", "concat('r', n_regionkey) AS canonical_id")
    new = nation.selectExpr("n_nationkey AS row_id", "concat(if(n_nationkey % 3 = 0, 's', 'r'), n_regionkey) AS canonical_id")
    return T.lineage(old, new)


@query("fact_changes", "SELECT p_partkey AS part_id, 'size' AS slot, CAST(p_size AS VARCHAR) AS old_value, CAST(p_size + 1 AS VARCHAR) AS new_value FROM part WHERE p_partkey % 20 = 0 UNION ALL SELECT p_partkey, 'brand', p_brand, NULL FROM part WHERE p_partkey % 30 = 0")
def fact_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = graph(spark, sf_dir).frame("Part")
    after = before.withColumns({"size": F.when(F.col("part_id") % 20 == 0, F.col("size") + 1).otherwise(F.col("size")), "brand": F.when(F.col("part_id") % 30 != 0, F.col("brand"))})
    return T.fact_changes(before, after, "part_id", ["size", "brand", "type"])


# Publishing


@query("merge_contributions", "SELECT l_partkey AS canonical_id, l_returnflag AS source, count(*) AS n FROM lineitem GROUP BY ALL")
def merge_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of all sources under the ids that their rows are bound to; all contributions are kept."""
    from trustweave.operators import trust

    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_quantity", "quantity")
    parts = [N.normalize(SPEC, SPEC.source(s), rows.where(F.col("l_returnflag") == s)).facts["Part"] for s in ("A", "N", "R")]
    bound = Q.union_all([p.select("row_id", F.col("src_key").cast("long").alias("canonical_id")) for p in parts]).distinct().withColumn("valid_to", F.lit(None).cast("timestamp_ntz"))
    return trust.merge(parts, bound).groupBy("canonical_id", "source").agg(F.count("*").alias("n"))


def part_build(spark: SparkSession, sf_dir: str, root: str) -> Build:
    """Line items as three sources of parts, to be built in a lake at ``root``."""
    rows = table(spark, sf_dir, "lineitem").withColumnsRenamed({f"l_{c}": c for c in ("quantity", "discount", "tax", "linestatus")})
    return Build(SPEC, Lake(spark, root), {s: lambda s=s: rows.where(F.col("l_returnflag") == s) for s in ("A", "N", "R")})


@query(
    "run_pipeline",
    f"""
    WITH {ROWS}, one AS (
        SELECT canonical_id, quantile_cont(quantity, 0.5) AS quantity, arg_max(discount, row(trust, asserted_at, source, discount)) AS discount,
            arg_max(tax, row(asserted_at, trust, source, tax)) AS tax FROM rows GROUP BY canonical_id
    ), votes AS (SELECT canonical_id, linestatus, count(*) AS n, max(trust) AS t FROM rows GROUP BY ALL),
    mode AS (SELECT canonical_id, arg_max(linestatus, row(n, t, linestatus)) AS linestatus FROM votes GROUP BY canonical_id)
    SELECT CAST(canonical_id AS VARCHAR) AS canonical_id, quantity, discount, tax, linestatus FROM one JOIN mode USING (canonical_id)
    """,
)
def run_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published parts, after all stages from source rows on."""
    import uuid

    build = part_build(spark, sf_dir, f"{shared_dir(spark)}/lake-{uuid.uuid4().hex}")
    build.run("run1", compile_spec(SPEC, "class:Part"))
    return build.lake.read("nodes/Part").select("canonical_id", "quantity", "discount", "tax", "linestatus")


@query("vertices", "SELECT 'Nation' AS kind, CAST(n_nationkey AS VARCHAR) AS node_id, n_name AS name, CAST(NULL AS VARCHAR) AS segment FROM nation UNION ALL SELECT 'Customer', CAST(c_custkey AS VARCHAR), c_name, c_mktsegment FROM customer")
def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    nodes = {"Nation": g.frame("Nation").select("nation_id", "name"), "Customer": g.frame("Customer").select("customer_id", "name", "segment")}
    return G.vertices(nodes, {"Nation": "nation_id", "Customer": "customer_id"})


@query("all_edges", "SELECT 'in_region' AS kind, CAST(n_nationkey AS VARCHAR) AS src_id, CAST(n_regionkey AS VARCHAR) AS dst_id FROM nation UNION ALL SELECT 'in_nation', CAST(c_custkey AS VARCHAR), CAST(c_nationkey AS VARCHAR) FROM customer")
def all_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return G.all_edges({"in_region": g.frame("Nation").select(F.col("nation_id").alias("src_id"), F.col("region").alias("dst_id")), "in_nation": g.frame("Customer").select(F.col("customer_id").alias("src_id"), F.col("nation").alias("dst_id"))})


@query("node_upsert", "SELECT p_partkey AS canonical_id, CASE WHEN p_partkey % 3 = 0 THEN p_size + 100 ELSE p_size END AS size FROM part")
def node_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = graph(spark, sf_dir).frame("Part").select(F.col("part_id").alias("canonical_id"), "size")
    return G.upsert_nodes(old, old.where("canonical_id % 3 = 0").withColumn("size", F.col("size") + 100))


@query("edge_upsert", "SELECT DISTINCT o_custkey AS src_id, o_orderkey AS dst_id FROM orders WHERE o_custkey % 2 = 0 AND o_orderstatus <> 'P'")
def edge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges without one of their ends are left out; repeated ones count once."""
    g = graph(spark, sf_dir)
    edges = g.frame("Order").select(F.col("customer").alias("src_id"), F.col("order_id").alias("dst_id"))
    sources = g.frame("Customer").where("customer_id % 2 = 0").select(F.col("customer_id").alias("canonical_id"))
    targets = g.frame("Order").where("status <> 'P'").select(F.col("order_id").alias("canonical_id"))
    return G.upsert_edges(edges.limit(0), edges.union(edges), sources, targets)


@query("walk_back", "SELECT 'r' || n_regionkey AS canonical_id, 'run1' AS run_id, 'abc' AS compile_hash, n_nationkey AS row_id, 'src' || (n_nationkey % 2) AS source, CAST(n_nationkey AS VARCHAR) AS src_key FROM nation WHERE n_regionkey < 3 UNION ALL SELECT 's' || n_regionkey, 'run2', NULL, n_nationkey, 'src' || (n_nationkey % 2), CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_nationkey % 3 = 0 AND n_nationkey <> 24 AND n_regionkey < 3")
def walk_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From facts to the runs and source rows that they come from."""
    bindings = _bindings(spark, sf_dir)
    facts = bindings.where("substring(canonical_id, 2, 1) < '3'").select("canonical_id")
    runs = spark.createDataFrame([("run1", "abc")], "run_id string, compile_hash string")
    sources = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS row_id", "concat('src', n_nationkey % 2) AS source", "string(n_nationkey) AS src_key")
    return lineage.walk_back(facts, bindings, runs, sources)


@query("contributions_by_source", "SELECT l_returnflag AS source, count(*) AS n, count(DISTINCT l_partkey) AS entities FROM lineitem GROUP BY 1")
def contributions_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contributions(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("canonical_id").alias("entities"))
