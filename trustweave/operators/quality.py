"""Data quality: checks that return one kind of row for each offender; an empty result is a pass."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trustweave import expr as X
from trustweave.model import DirectRef, ModelError, Policy, Spec
from trustweave.operators import trust
from trustweave.plans.lowering import Graph
from trustweave.sources.shared import stored

OFFENDER = ("rule_id", "class_name", "slot_name", "offending_pk", "detail")
ERROR, WARNING = "error", "warning"


class BlockedPublish(ModelError):
    """A check of severity error has offenders."""


def offenders(df: DataFrame, rule: str, cls: str, slot: str | None, key: str, detail: Column | str) -> DataFrame:
    """The uniform shape."""
    return df.select(
        F.lit(rule).alias("rule_id"), F.lit(cls).alias("class_name"), F.lit(slot).cast("string").alias("slot_name"),
        F.col(key).cast("string").alias("offending_pk"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"),
    )


def violations(graph: Graph, cls: str, rule: str, must_hold: X.Node) -> DataFrame:
    """Rows for which a condition isn't provably true."""
    df, column = graph.bind(cls, must_hold, graph.frame(cls))
    return offenders(df.where(~F.coalesce(column, F.lit(False))), rule, cls, None, graph.key(cls), "constraint violated")


def bad_rows(graph: Graph, cls: str, rule: str, bad_if: X.Node) -> DataFrame:
    """Rows for which a condition is true."""
    return offenders(graph.where(cls, bad_if), rule, cls, None, graph.key(cls), "offending condition holds")


def required(df: DataFrame, cls: str, slot: str, key: str) -> DataFrame:
    return offenders(df.where(F.col(slot).isNull()), f"required:{cls}.{slot}", cls, slot, key, "required value is null")


def in_range(df: DataFrame, cls: str, slot: str, key: str, minimum: Any = None, maximum: Any = None) -> DataFrame:
    low = F.col(slot) < F.lit(minimum) if minimum is not None else F.lit(False)
    high = F.col(slot) > F.lit(maximum) if maximum is not None else F.lit(False)
    detail = F.concat(F.col(slot).cast("string"), F.lit(f" is outside {minimum}..{maximum}"))
    return offenders(df.where(low | high), f"range:{cls}.{slot}", cls, slot, key, detail)


def well_formed(df: DataFrame, cls: str, slot: str, key: str, pattern: str) -> DataFrame:
    return offenders(df.where(~F.col(slot).rlike(pattern)), f"pattern:{cls}.{slot}", cls, slot, key, F.concat(F.col(slot), F.lit(" doesn't match the pattern")))


def permitted(df: DataFrame, cls: str, slot: str, key: str, values: tuple[str, ...]) -> DataFrame:
    return offenders(df.where(~F.col(slot).isin(*values)), f"enum:{cls}.{slot}", cls, slot, key, F.concat(F.col(slot), F.lit(" is not permitted")))


def unique(df: DataFrame, cls: str, slots: tuple[str, ...]) -> DataFrame:
    """Keys that several rows hold."""
    name = ",".join(slots)
    held = df.groupBy(*slots).agg(F.count("*").alias("_n")).where("_n > 1")
    keyed = held.withColumn("_pk", F.concat_ws("|", *[F.col(s).cast("string") for s in slots]))
    return offenders(keyed, f"unique:{cls}.{name}", cls, name, "_pk", F.concat(F.col("_n").cast("string"), F.lit(" rows share this key")))


def referential(df: DataFrame, cls: str, slot: str, key: str, target: DataFrame, target_key: str) -> DataFrame:
    """Rows whose foreign key leads nowhere; a null key refers to nothing and is no offence."""
    there = target.select(F.col(target_key).alias("_there"))
    orphans = df.where(F.col(slot).isNotNull()).join(there, F.col(slot) == F.col("_there"), "left_anti")
    return offenders(orphans, f"referential:{cls}.{slot}", cls, slot, key, F.concat(F.lit("no target "), F.col(slot).cast("string")))


def agreement(contributions: DataFrame, spec: Spec, cls: str) -> DataFrame:
    """Disagreeing sources on slots that must be unique."""
    if trust.ID not in contributions.columns:
        raise ModelError("the check of agreement needs canonical ids")
    slots = [s.name for s in spec.slots(cls) if s.policy is Policy.UNIQUE_OR_FAIL and s.name in contributions.columns]
    parts = [offenders(trust.disagreements(contributions, s), f"agreement:{cls}.{s}", cls, s, trust.ID, F.col("detail")) for s in slots]
    return union_all(parts) if parts else contributions.sparkSession.createDataFrame([], ", ".join(f"{c} string" for c in OFFENDER))


def freshness(rows: DataFrame, cls: str, by: str, moment: str, as_of: Any, interval: str) -> DataFrame:
    """Sources, or other groups, whose latest row is older than an interval before ``as_of``."""
    latest = rows.groupBy(by).agg(F.max(moment).alias("_latest"))
    old = latest.where(F.col("_latest") < F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {interval}"))
    return offenders(old, f"freshness:{cls}", cls, moment, by, F.concat(F.lit("latest is "), F.date_format("_latest", "yyyy-MM-dd HH:mm:ss")))


def cluster_outliers(clusters: DataFrame, cls: str, z: float = 3.0, least: int = 5, key: str = trust.ID) -> DataFrame:
    """Clusters that are far larger than usual."""
    sizes = clusters.groupBy(key).agg(F.count("*").alias("_n"))
    usual = sizes.agg(F.avg("_n").alias("_mean"), F.stddev_samp("_n").alias("_sd"))
    far = sizes.join(F.broadcast(usual)).where((F.col("_n") >= least) & (F.col("_n") >= F.col("_mean") + z * F.col("_sd")))
    return offenders(far, f"cluster_size:{cls}", cls, None, key, F.concat(F.lit("cluster of "), F.col("_n").cast("string")))


def degree_outliers(edges: DataFrame, cls: str, share: float = 0.99, least: int = 5) -> DataFrame:
    """Nodes with more edges than the given share of nodes."""
    degree = edges.groupBy("src_id").agg(F.count("*").alias("_n"))
    bound = degree.agg(F.percentile("_n", share).alias("_bound"))
    far = degree.join(F.broadcast(bound)).where((F.col("_n") > F.col("_bound")) & (F.col("_n") >= least))
    return offenders(far, f"degree:{cls}", cls, None, "src_id", F.concat(F.lit("degree "), F.col("_n").cast("string")))


def cycles(edges: DataFrame, cls: str) -> DataFrame:
    """Nodes that reach themselves over edges (src_id, dst_id), with the length of their shortest cycle, of any length.

    Edges that lead from or to a dead end are peeled off until none is left. Then each node walks on, to places it
    hasn't been to, until it meets itself or finds nothing new. Each round is a stored table.
    """
    step = stored(edges.where("src_id IS NOT NULL AND dst_id IS NOT NULL").select("src_id", "dst_id").distinct())
    n, left = None, step.count()
    while n != left:
        on, back = step.select(F.col("src_id").alias("dst_id")).distinct(), step.select(F.col("dst_id").alias("src_id")).distinct()
        step = stored(step.join(on, "dst_id", "left_semi").join(back, "src_id", "left_semi").select("src_id", "dst_id"))
        n, left = left, step.count()
    hop = step.select(F.col("src_id").alias("dst_id"), F.col("dst_id").alias("_next"))
    walk, seen, length = step, step, 1
    found = [step.where("src_id = dst_id").select("src_id", F.lit(1).alias("_length"))]
    while True:
        going = walk.join(walk.where("src_id = dst_id").select("src_id"), "src_id", "left_anti")
        walk = stored(going.join(hop, "dst_id").select("src_id", F.col("_next").alias("dst_id")).distinct().join(seen, ["src_id", "dst_id"], "left_anti"))
        if walk.limit(1).count() == 0:
            break
        length += 1
        seen = stored(seen.unionByName(walk))
        found.append(stored(walk.where("src_id = dst_id").select("src_id", F.lit(length).alias("_length"))))
    return offenders(union_all(found), f"cycle:{cls}", cls, None, "src_id", F.concat(F.lit("cycle of length "), F.col("_length").cast("string")))


def null_rate_trend(runs: DataFrame, cls: str, slot: str, run: str = "run_no", rise: float = 0.01) -> DataFrame:
    """Whether the share of nulls grows from run to run, by a regression over the runs' shares."""
    per_run = runs.groupBy(run).agg(F.avg(F.col(slot).isNull().cast("double")).alias("_share"))
    slope = per_run.agg(F.regr_slope("_share", F.col(run).cast("double")).alias("_slope"))
    rising = slope.where(F.col("_slope") > rise).withColumn("_pk", F.lit(slot))
    return offenders(rising, f"null_trend:{cls}.{slot}", cls, slot, "_pk", F.concat(F.lit("null share rises by "), F.round("_slope", 6).cast("string"), F.lit(" a run")))


def failure_rate_trend(results: DataFrame, cls: str, run: str = "run_no", rise: float = 0.01) -> DataFrame:
    """Rules whose share of failing rows (run, rule_id, n_failed, n_rows) grows from run to run."""
    share = F.col("n_failed") / F.col("n_rows")
    slope = results.groupBy("rule_id").agg(F.regr_slope(share, F.col(run).cast("double")).alias("_slope")).where(F.col("_slope") > rise)
    return offenders(slope.withColumnRenamed("rule_id", "_rule"), f"failure_trend:{cls}", cls, None, "_rule", F.concat(F.lit("failures rise by "), F.round("_slope", 6).cast("string"), F.lit(" a run")))


def coverage_drop(rows: DataFrame, cls: str, by: str, run: str = "run_no", drop: float = 0.5) -> DataFrame:
    """Sources with far fewer rows than in the run before."""
    counts = rows.groupBy(by, run).agg(F.count("*").alias("_n"))
    before = F.lag("_n").over(Window.partitionBy(by).orderBy(run))
    fell = counts.withColumn("_before", before).where(F.col("_n") < F.col("_before") * (1 - drop))
    return offenders(fell, f"coverage:{cls}", cls, None, by, F.concat(F.lit("from "), F.col("_before").cast("string"), F.lit(" to "), F.col("_n").cast("string"), F.lit(" rows")))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def validate(graph: Graph, cls: str) -> DataFrame:
    """All checks that the model declares for a class."""
    spec, df, key = graph.spec, graph.frame(cls), graph.key(cls)
    parts = [unique(df, cls, (key,))] + [unique(df, cls, k) for k in spec.cls(cls).unique_keys]
    for s in spec.slots(cls):
        if s.name not in df.columns:
            continue
        if s.required or s.identifier:
            parts.append(required(df, cls, s.name, key))
        if s.minimum is not None or s.maximum is not None:
            parts.append(in_range(df, cls, s.name, key, s.minimum, s.maximum))
        if (pattern := spec.pattern(s)) is not None:
            parts.append(well_formed(df, cls, s.name, key, pattern))
        if s.permissible:
            parts.append(permitted(df, cls, s.name, key, s.permissible))
        target = s.reference.target if isinstance(s.reference, DirectRef) else s.range if spec.is_class(s.range) and s.reference is None else None
        if target is not None:
            parts.append(referential(df, cls, s.name, key, graph.frame(target), graph.key(target)))
    for rule, body in spec.cls(cls).constraints.items():
        parts.append(violations(graph, cls, rule, body))
    return union_all(parts)


def gate(checks: dict[str, tuple[str, Callable[[], DataFrame] | DataFrame]]) -> dict[str, int]:
    """Numbers of offenders by check; those of severity error stop what follows."""
    found = {name: (check() if callable(check) else check).count() for name, (_, check) in checks.items()}
    bad = [f"{name}: {found[name]}" for name, (severity, _) in checks.items() if severity == ERROR and found[name]]
    if bad:
        raise BlockedPublish("offenders in " + ", ".join(bad))
    return found
