"""Bindings of source rows to canonical ids over time, and reads as of a moment."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

COLUMNS = ("row_id", "canonical_id", "valid_from", "valid_to", "run_id", "change_type")


def update_bindings(old: DataFrame, new: DataFrame, moment: Any, run_id: str) -> DataFrame:
    """The history after a run: rows whose id changed or that went are closed, new ones opened, others left alone.

    ``old`` has COLUMNS, ``new`` row_id and canonical_id.
    """
    now = F.lit(moment).cast("timestamp_ntz")
    past, current = old.where("valid_to IS NOT NULL"), old.where("valid_to IS NULL")
    fresh = new.select(F.col("row_id").alias("_row"), F.col("canonical_id").alias("_id"))
    both = current.join(fresh, current["row_id"] == fresh["_row"], "full")
    same = F.col("canonical_id").eqNullSafe(F.col("_id"))
    held = both.where("row_id IS NOT NULL").select(
        "row_id", "canonical_id", "valid_from", F.when(~same, now).alias("valid_to"), "run_id", "change_type"
    )
    opened = both.where(F.col("_row").isNotNull() & (F.col("row_id").isNull() | ~same)).select(
        F.col("_row").alias("row_id"), F.col("_id").alias("canonical_id"), now.alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"),
        F.lit(run_id).alias("run_id"), F.when(F.col("row_id").isNull(), "new").otherwise("changed").alias("change_type"),
    )
    return past.select(*COLUMNS).union(held).union(opened)


def history(changes: DataFrame, key: str, value: str, moment: str) -> DataFrame:
    """Slowly changing rows (key, value, valid_from, valid_to) from a log of values: successive equal ones are one."""
    order = Window.partitionBy(key).orderBy(moment, value)
    kept = changes.select(key, value, moment).withColumn("_before", F.lag(value).over(order)).where(~F.col(value).eqNullSafe(F.col("_before")) | F.col("_before").isNull())
    return kept.select(key, value, F.col(moment).alias("valid_from"), F.lead(moment).over(order).alias("valid_to"))


def as_of(bindings: DataFrame, moment: Any) -> DataFrame:
    """Rows valid at a moment: from valid_from on, until just before valid_to."""
    m = F.lit(moment).cast("timestamp_ntz")
    return bindings.where((F.col("valid_from") <= m) & (m < F.coalesce("valid_to", F.lit("9999-12-31").cast("timestamp_ntz"))))


def as_of_join(events: DataFrame, versions: DataFrame, key: str, moment: str) -> DataFrame:
    """Each event beside the version of its key that was valid then; events before the first version have none.

    One window over both, sorted by key and time, in place of a range join.
    """
    values = [c for c in versions.columns if c not in (key, "valid_from", "valid_to")]
    own = [c for c in events.columns if c not in (key, moment)]
    left = events.select(key, F.col(moment).alias("_t"), F.lit(1).alias("_side"), F.struct(*own).alias("_own"), F.lit(None).cast(versions.select(F.struct(*values, "valid_to").alias("s")).schema[0].dataType).alias("_version"))
    right = versions.select(key, F.col("valid_from").alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(events.select(F.struct(*own).alias("s")).schema[0].dataType).alias("_own"), F.struct(*values, "valid_to").alias("_version"))
    last = F.last("_version", ignorenulls=True).over(Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0))
    seen = left.union(right).withColumn("_at", last).where("_side = 1")
    valid = F.col("_at").isNotNull() & (F.col("_at.valid_to").isNull() | (F.col("_t") < F.col("_at.valid_to")))
    return seen.select(key, F.col("_t").alias(moment), *[F.col(f"_own.{c}").alias(c) for c in own], *[F.when(valid, F.col(f"_at.{c}")).alias(c) for c in values])


def redirects(bindings: DataFrame) -> DataFrame:
    """Old canonical ids and the current ones of the rows that they once held: old_id, current_id."""
    old, now = bindings.alias("old"), bindings.where("valid_to IS NULL").alias("now")
    joined = old.join(now, F.col("old.row_id") == F.col("now.row_id"))
    return joined.select(F.col("old.canonical_id").alias("old_id"), F.col("now.canonical_id").alias("current_id")).distinct()


def lineage(old: DataFrame, new: DataFrame) -> DataFrame:
    """Merges and splits between two states (row_id, canonical_id): old_id, new_id, kind."""
    pairs = old.select("row_id", F.col("canonical_id").alias("old_id")).join(new.select("row_id", F.col("canonical_id").alias("new_id")), "row_id").select("old_id", "new_id").distinct()
    into = pairs.groupBy("new_id").agg(F.count("*").alias("_from"))
    out = pairs.groupBy("old_id").agg(F.count("*").alias("_to"))
    kind = F.when(F.col("_to") > 1, "split").when(F.col("_from") > 1, "merge")
    return pairs.join(into, "new_id").join(out, "old_id").select("old_id", "new_id", kind.alias("kind")).where("kind IS NOT NULL")


def fact_changes(before: DataFrame, after: DataFrame, key: str, slots: list[str]) -> DataFrame:
    """Cells that differ between two states: key, slot, old_value, new_value, as text."""
    cells = lambda d, name: d.select(key, F.explode(F.array(*[F.struct(F.lit(s).alias("slot"), F.col(s).cast("string").alias("value")) for s in slots])).alias("x")).select(key, "x.slot", F.col("x.value").alias(name))
    both = cells(before, "old_value").join(cells(after, "new_value"), [key, "slot"], "full")
    return both.where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def since(df: DataFrame, column: str, cursor: Any | None) -> DataFrame:
    """Rows beyond a source's cursor; all of them without one."""
    return df if cursor is None else df.where(F.col(column) > F.lit(cursor).cast(df.schema[column].dataType))


def cursor_of(df: DataFrame, column: str) -> Any:
    return df.agg(F.max(column)).first()[0]
