"""Queries that resolve what sources say."""

from __future__ import annotations

import datetime
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustweave.expr import path
from trustweave.model import Policy
from trustweave.operators import quality, trust
from trustweave.plans.binding import SPEC, contributions, graph, table
from trustweave.plans.registry import query

#: Contributions in SQL, as in trustweave.plans.binding.
ROWS = """rows AS (
    SELECT l_partkey AS canonical_id, l_returnflag AS source, l_shipdate AS asserted_at, l_quantity AS quantity, l_discount AS discount,
        l_tax AS tax, l_linestatus AS linestatus,
        CAST(CASE l_returnflag WHEN 'A' THEN 0.91 WHEN 'N' THEN 0.62 WHEN 'R' THEN 0.48 END AS DOUBLE) AS trust
    FROM lineitem
)"""
ARGMAX = "arg_max(discount, row(trust, asserted_at, source, discount)) FILTER (discount IS NOT NULL)"


@query("trust_argmax", f"WITH {ROWS} SELECT canonical_id, {ARGMAX} AS discount FROM rows GROUP BY canonical_id")
def trust_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trust.resolve(contributions(spark, sf_dir), "discount")


@query(
    "trust_argmax_with_nulls",
    f"WITH {ROWS}, holed AS (SELECT canonical_id, source, asserted_at, trust, CASE WHEN source <> 'A' THEN discount END AS discount FROM rows) SELECT canonical_id, {ARGMAX} AS discount FROM holed GROUP BY canonical_id",
)
def trust_argmax_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most trusted source has no values: the next one counts."""
    rows = contributions(spark, sf_dir)
    return trust.resolve(rows.withColumn("discount", F.when(F.col("source") != "A", F.col("discount"))), "discount")


@query("trust_latest", f"WITH {ROWS} SELECT canonical_id, arg_max(tax, row(asserted_at, trust, source, tax)) AS tax FROM rows GROUP BY canonical_id")
def trust_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trust.resolve(contributions(spark, sf_dir), "tax", Policy.LATEST_WATERMARK)


@query("trust_median", f"WITH {ROWS} SELECT canonical_id, quantile_cont(quantity, 0.5) AS quantity FROM rows GROUP BY canonical_id")
def trust_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trust.resolve(contributions(spark, sf_dir), "quantity", Policy.MEDIAN_NUMERIC)


@query(
    "trust_mode",
    f"WITH {ROWS}, votes AS (SELECT canonical_id, linestatus, count(*) AS n, max(trust) AS t FROM rows GROUP BY ALL) SELECT canonical_id, arg_max(linestatus, row(n, t, linestatus)) AS linestatus FROM votes GROUP BY canonical_id",
)
def trust_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trust.resolve(contributions(spark, sf_dir), "linestatus", Policy.MODE)


@query(
    "trust_weighted_vote",
    f"WITH {ROWS}, votes AS (SELECT canonical_id, discount, round(sum(trust), 9) AS n, max(trust) AS t FROM rows GROUP BY canonical_id, discount) SELECT canonical_id, arg_max(discount, row(n, t, discount)) AS discount FROM votes GROUP BY canonical_id",
)
def trust_weighted_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trust.resolve(contributions(spark, sf_dir), "discount", Policy.WEIGHTED_VOTE)


@query(
    "trust_mode_multivalued",
    """
    WITH words AS (SELECT o_custkey AS canonical_id, unnest([o_orderstatus, o_orderpriority]) AS tags FROM orders),
    votes AS (SELECT canonical_id, tags, count(*) AS n FROM words GROUP BY ALL),
    most AS (SELECT canonical_id, max(n) AS m FROM votes GROUP BY canonical_id)
    SELECT canonical_id, string_agg(tags, ',' ORDER BY tags) AS tags FROM votes JOIN most USING (canonical_id) WHERE n = m GROUP BY canonical_id
    """,
)
def trust_mode_multivalued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list's mode is taken element by element."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("canonical_id"), F.lit(0.5).alias("trust"), F.array("o_orderstatus", "o_orderpriority").alias("tags"))
    return trust.resolve(rows, "tags", Policy.MODE, multivalued=True).select("canonical_id", F.array_join("tags", ",").alias("tags"))


@query(
    "trust_class",
    f"""
    WITH {ROWS}, one AS (
        SELECT canonical_id, quantile_cont(quantity, 0.5) AS quantity, arg_max(discount, row(trust, asserted_at, source, discount)) AS discount,
            arg_max(tax, row(asserted_at, trust, source, tax)) AS tax FROM rows GROUP BY canonical_id
    ), votes AS (SELECT canonical_id, linestatus, count(*) AS n, max(trust) AS t FROM rows GROUP BY ALL),
    mode AS (SELECT canonical_id, arg_max(linestatus, row(n, t, linestatus)) AS linestatus FROM votes GROUP BY canonical_id)
    SELECT canonical_id, quantity, discount, tax, linestatus FROM one JOIN mode USING (canonical_id)
    """,
)
def trust_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All slots of a class, each by its policy."""
    return trust.resolve_class(contributions(spark, sf_dir), SPEC, "Part")


@query(
    "trust_slot_override",
    f"""
    WITH {ROWS}, weighed AS (SELECT * REPLACE (CASE source WHEN 'A' THEN 0.1::DOUBLE ELSE trust END AS trust) FROM rows)
    SELECT canonical_id, {ARGMAX} AS discount, arg_max(tax, row(asserted_at, trust, source, tax)) AS tax FROM weighed GROUP BY canonical_id
    """,
)
def trust_slot_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source A counts least for two slots, whatever it counts for others."""
    spec = replace(SPEC, sources=tuple(replace(s, slot_trust={"discount": 0.1, "tax": 0.1}) if s.name == "A" else s for s in SPEC.sources))
    return trust.resolve_class(contributions(spark, sf_dir), spec, "Part", ["discount", "tax"])


@query(
    "unique_or_fail_offenders",
    f"""
    WITH {ROWS}, v AS (SELECT canonical_id, list_sort(list_distinct(list(linestatus))) AS s FROM rows GROUP BY canonical_id)
    SELECT 'agreement:Part.linestatus' AS rule_id, 'Part' AS class_name, 'linestatus' AS slot_name, CAST(canonical_id AS VARCHAR) AS offending_pk,
        len(s) || ' sources disagree: ' || array_to_string(s, ', ') AS detail FROM v WHERE len(s) > 1
    """,
)
def unique_or_fail_offenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trust.disagreements(contributions(spark, sf_dir), "linestatus")
    return quality.offenders(found, "agreement:Part.linestatus", "Part", "linestatus", "canonical_id", F.col("detail"))


@query("null_contributions", f"WITH {ROWS} SELECT canonical_id, CAST(count_if(tax = 0.0) AS BIGINT) AS n_null_contributions FROM rows GROUP BY canonical_id")
def null_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contributions(spark, sf_dir).withColumn("tax", F.expr("nullif(tax, 0.0D)"))
    return trust.null_contributions(rows, "tax")


@query(
    "from_source",
    f"WITH {ROWS}, r AS (SELECT canonical_id, {ARGMAX} AS d FROM rows WHERE source = 'N' GROUP BY canonical_id) SELECT p_partkey AS part_id FROM part JOIN r ON canonical_id = p_partkey WHERE d > 0.05",
)
def from_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).where("Part", path("Part", "discount").from_source("N") > 0.05).select("part_id")


@query("source_null", f"WITH {ROWS}, r AS (SELECT DISTINCT canonical_id FROM rows WHERE source = 'R') SELECT p_partkey AS part_id FROM part JOIN r ON canonical_id = p_partkey")
def source_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities on which one source has a value."""
    return graph(spark, sf_dir).where("Part", path("Part", "discount").from_source("R").is_not_null()).select("part_id")


@query("all_sources", f"WITH {ROWS}, r AS (SELECT canonical_id, bool_and(quantity > 10) AS ok FROM rows GROUP BY canonical_id) SELECT p_partkey AS part_id FROM part JOIN r ON canonical_id = p_partkey WHERE ok")
def all_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).where("Part", path("Part", "quantity").all_() > 10).select("part_id")


@query("any_source", f"WITH {ROWS}, r AS (SELECT canonical_id, bool_or(quantity BETWEEN 49 AND 50) AS ok FROM rows GROUP BY canonical_id) SELECT p_partkey AS part_id FROM part JOIN r ON canonical_id = p_partkey WHERE ok")
def any_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trustweave.expr import Between, Literal

    test = Between(path("Part", "quantity").any_(), Literal(49), Literal(50))
    return graph(spark, sf_dir).where("Part", test).select("part_id")


@query(
    "any_source_as_of",
    f"WITH {ROWS}, r AS (SELECT canonical_id, bool_or(quantity > 45) AS ok FROM rows WHERE asserted_at <= TIMESTAMP '1995-06-30' GROUP BY canonical_id) SELECT p_partkey AS part_id FROM part JOIN r ON canonical_id = p_partkey WHERE ok",
)
def any_source_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only what had been asserted by then counts."""
    slot = path("Part", "quantity").any_().as_of(datetime.datetime(1995, 6, 30))
    return graph(spark, sf_dir).where("Part", slot > 45).select("part_id")


@query("winner", f"WITH {ROWS}, r AS (SELECT canonical_id, {ARGMAX} AS d FROM rows GROUP BY canonical_id) SELECT p_partkey AS part_id, d AS discount FROM part LEFT JOIN r ON canonical_id = p_partkey")
def winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).derive("Part", {"discount": path("Part", "discount").winner()}).select("part_id", "discount")


@query(
    "contributions",
    f"""
    WITH {ROWS} SELECT canonical_id, string_agg(printf('%s:%.2f:%s', source, discount, strftime(asserted_at, '%Y-%m-%d')), ';' ORDER BY source, discount, asserted_at) AS discount
    FROM rows GROUP BY canonical_id
    """,
)
def contribution_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trust.contribution_list(contributions(spark, sf_dir), "discount")
    shown = F.transform("discount", lambda x: F.concat_ws(":", x["source"], F.format_string("%.2f", x["value"]), F.date_format(x["asserted_at"], "yyyy-MM-dd")))
    return rows.select("canonical_id", F.array_join(shown, ";").alias("discount"))


@query(
    "correction_overlay",
    f"""
    WITH {ROWS}, resolved AS (SELECT canonical_id, {ARGMAX} AS discount FROM rows GROUP BY canonical_id),
    fixes AS (SELECT canonical_id, arg_max(v, row(t, v)) AS v FROM (
        SELECT l_partkey AS canonical_id, CAST(l_tax AS VARCHAR) AS v, l_shipdate AS t FROM lineitem WHERE l_partkey % 7 = 0 AND l_returnflag = 'R') GROUP BY canonical_id)
    SELECT canonical_id, coalesce(CAST(v AS DOUBLE), discount) AS discount FROM resolved LEFT JOIN fixes USING (canonical_id)
    """,
)
def correction_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trust.overlay(trust.resolve(contributions(spark, sf_dir), "discount"), _corrections(spark, sf_dir), ["discount"])


def _corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_partkey % 7 = 0 AND l_returnflag = 'R'")
    return rows.select(F.col("l_partkey").alias("canonical_id"), F.lit("discount").alias("slot"), F.col("l_tax").cast("string").alias("value"), F.col("l_shipdate").alias("submitted_at"))


@query(
    "correction_source",
    f"""
    WITH {ROWS}, more AS (
        SELECT canonical_id, source, asserted_at, discount, trust FROM rows
        UNION ALL SELECT l_partkey, 'correction', l_shipdate, l_tax, CAST(1.0 AS DOUBLE) FROM lineitem WHERE l_partkey % 7 = 0 AND l_returnflag = 'R'
    ) SELECT canonical_id, {ARGMAX} AS discount FROM more GROUP BY canonical_id
    """,
)
def correction_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contributions(spark, sf_dir)
    return trust.resolve(trust.corrections_as_source(rows, _corrections(spark, sf_dir), "discount"), "discount")


@query(
    "beta_trust",
    "SELECT l_returnflag AS source, CAST(1 + count_if(l_tax < 0.04) AS DOUBLE) AS alpha, CAST(1 + count_if(NOT l_tax < 0.04) AS DOUBLE) AS beta, round((1.0 + count_if(l_tax < 0.04)) / (2.0 + count(*)), 9) AS trust FROM lineitem GROUP BY 1",
)
def beta_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("source"), (F.col("l_tax") < 0.04).alias("won"))
    return trust.beta_trust(outcomes).withColumn("trust", F.round("trust", 9))
