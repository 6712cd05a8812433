"""Resolution of disagreeing contributions, and the ways to look at them.

A contribution table has canonical_id, source, trust, asserted_at and the slots. Null values are no contributions, and
ties are broken by a total order, so a result never depends on the order of rows: by trust, time, source and value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustweave.model import NUMERIC, ModelError, Policy, Spec

ID = "canonical_id"


class Disagreement(ModelError):
    """Sources disagree on a slot that must be unique."""


def with_trust(rows: DataFrame, spec: Spec, slot: str | None = None) -> DataFrame:
    """Add each row's trust: the source's weight, or its weight for the slot.

    Weights are part of the model, so they become a CASE expression and no join.
    """
    weight = F.lit(None).cast("double")
    for s in spec.sources:
        weight = F.when(F.col("source") == s.name, F.lit(float(s.slot_trust.get(slot, s.trust) if slot else s.trust))).otherwise(weight)
    return rows.withColumn("trust", weight)


def slot_weight(spec: Spec, slot: str) -> Column:
    """A row's trust, but its source's weight for the slot where the model gives one."""
    weight = F.col("trust")
    for s in spec.sources:
        if slot in s.slot_trust:
            weight = F.when(F.col("source") == s.name, F.lit(float(s.slot_trust[slot]))).otherwise(weight)
    return weight.alias("trust")


def _known(slot: str, *order: str | Column) -> Column:
    """An order over the rows where the slot has a value; null elsewhere, which max_by passes over."""
    return F.when(F.col(slot).isNotNull(), F.struct(*order, slot))


def _single(slot: str, policy: Policy, weight: str | Column = "trust") -> Column:
    match policy:
        case Policy.ARGMAX_TRUST:
            return F.max_by(slot, _known(slot, weight, "asserted_at", "source"))
        case Policy.LATEST_WATERMARK:
            return F.max_by(slot, _known(slot, "asserted_at", weight, "source"))
        case Policy.MEDIAN_NUMERIC:
            return F.median(slot)
        case Policy.UNIQUE_OR_FAIL:
            return F.when(F.countDistinct(slot) <= 1, F.max(slot))
    raise ModelError(f"{policy.value} takes two steps")


def _voted(rows: DataFrame, slot: str, policy: Policy, multivalued: bool, weight: str | Column = "trust") -> DataFrame:
    """Two-level votes: by value, then the value with most; of a multivalued slot all elements with most."""
    rows = rows.select(ID, weight, (F.explode(slot) if multivalued else F.col(slot)).alias(slot)).where(F.col(slot).isNotNull())
    by_value = rows.groupBy(ID, slot).agg(
        (F.count("*") if policy is Policy.MODE else F.round(F.sum("trust"), 9)).alias("_votes"), F.max("trust").alias("_trust")
    )
    if multivalued:
        most = by_value.groupBy(ID).agg(F.max("_votes").alias("_most"))
        return by_value.join(most, ID).where("_votes = _most").groupBy(ID).agg(F.sort_array(F.collect_list(slot)).alias(slot))
    return by_value.groupBy(ID).agg(F.max_by(slot, F.struct("_votes", "_trust", slot)).alias(slot))


def resolve(rows: DataFrame, slot: str, policy: Policy = Policy.ARGMAX_TRUST, multivalued: bool = False) -> DataFrame:
    """canonical_id and the resolved slot; entities without a value have null.

    UNIQUE_OR_FAIL fails at once if sources disagree: a check inside the plan could be pruned with its column.
    """
    if policy is Policy.UNIQUE_OR_FAIL:
        first = disagreements(rows, slot).limit(1).collect()
        if first:
            raise Disagreement(f"{slot} of {first[0][ID]!r}: {first[0]['detail']}")
    if policy in (Policy.MODE, Policy.WEIGHTED_VOTE):
        ids = rows.select(ID).distinct()
        return ids.join(_voted(rows, slot, policy, multivalued), ID, "left")
    return rows.groupBy(ID).agg(_single(slot, policy).alias(slot))


def resolve_class(rows: DataFrame, spec: Spec, cls: str, slots: list[str] | None = None, strict: bool = True) -> DataFrame:
    """All slots of a class, each by its policy: one aggregation for all that take one step, one more for each vote.

    A source's weight for a slot, where the model gives one, counts instead of the row's trust.

    Without ``strict`` a slot that must be unique is null where sources disagree.
    """
    wanted = [s for s in spec.slots(cls) if s.derivation is None and s.name in rows.columns and (slots is None or s.name in slots)]
    for s in wanted:
        if s.policy is Policy.MEDIAN_NUMERIC and spec.base_type(s) not in NUMERIC:
            raise ModelError(f"{cls}.{s.name}: a median needs a numeric range")
        if strict and s.policy is Policy.UNIQUE_OR_FAIL:
            resolve(rows, s.name, s.policy)
    votes = [s for s in wanted if s.policy in (Policy.MODE, Policy.WEIGHTED_VOTE)]
    plain = [_single(s.name, s.policy, slot_weight(spec, s.name)).alias(s.name) for s in wanted if s not in votes]
    made = rows.groupBy(ID).agg(*plain) if plain else rows.select(ID).distinct()
    for s in votes:
        made = made.join(_voted(rows, s.name, s.policy, s.multivalued, slot_weight(spec, s.name)), ID, "left")
    return made.select(ID, *[s.name for s in wanted])


def disagreements(rows: DataFrame, slot: str) -> DataFrame:
    """Entities for which sources give several values: canonical_id and detail."""
    values = F.sort_array(F.collect_set(F.col(slot).cast("string")))
    found = rows.groupBy(ID).agg(values.alias("_values")).where(F.size("_values") > 1)
    return found.select(ID, F.concat(F.size("_values").cast("string"), F.lit(" sources disagree: "), F.array_join("_values", ", ")).alias("detail"))


def null_contributions(rows: DataFrame, slot: str) -> DataFrame:
    """How many sources say that there is no value, which differs from saying nothing."""
    return rows.groupBy(ID).agg(F.count_if(F.col(slot).isNull()).alias("n_null_contributions"))


def from_source(rows: DataFrame, source: str) -> DataFrame:
    return rows.where(F.col("source") == source)


def every(rows: DataFrame, slot: str, test: Column) -> DataFrame:
    """Whether the test holds for all values; null without any."""
    return rows.groupBy(ID).agg(F.bool_and(F.when(F.col(slot).isNotNull(), test)).alias(slot))


def some(rows: DataFrame, slot: str, test: Column) -> DataFrame:
    """Whether the test holds for any value; null without any."""
    return rows.groupBy(ID).agg(F.bool_or(F.when(F.col(slot).isNotNull(), test)).alias(slot))


def contribution_list(rows: DataFrame, slot: str) -> DataFrame:
    """All contributions of each entity, as a sorted list of (source, value, trust, asserted_at)."""
    entry = F.struct("source", F.col(slot).alias("value"), "trust", "asserted_at")
    return rows.groupBy(ID).agg(F.sort_array(F.collect_list(entry)).alias(slot))


def overlay(resolved: DataFrame, corrections: DataFrame, slots: list[str]) -> DataFrame:
    """Resolved values under the latest correction of each entity and slot: (canonical_id, slot, value, submitted_at)."""
    for slot in slots:
        latest = (
            corrections.where(F.col("slot") == slot)
            .groupBy(F.col(ID).alias("_to"))
            .agg(F.max_by("value", F.struct("submitted_at", "value")).alias("_value"))
        )
        kind = resolved.schema[slot].dataType
        names = resolved.columns
        joined = resolved.join(latest, resolved[ID] == F.col("_to"), "left").withColumn(slot, F.coalesce(F.col("_value").try_cast(kind), F.col(slot)))
        resolved = joined.select(*names)
    return resolved


def corrections_as_source(rows: DataFrame, corrections: DataFrame, slot: str, trust: float = 1.0) -> DataFrame:
    """Contributions with corrections of a slot added as one more source, of the given trust."""
    mine = corrections.where(F.col("slot") == slot).select(
        ID, F.lit("correction").alias("source"), F.lit(trust).alias("trust"), F.col("submitted_at").alias("asserted_at"), F.col("value").try_cast(rows.schema[slot].dataType).alias(slot)
    )
    return rows.unionByName(mine, allowMissingColumns=True)


def beta_trust(outcomes: DataFrame, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """Trust of each source as the mean of a Beta distribution over its wins and losses: (source, won)."""
    counted = outcomes.groupBy("source").agg(
        (F.lit(alpha) + F.count_if("won")).alias("alpha"), (F.lit(beta) + F.count_if(~F.col("won"))).alias("beta")
    )
    return counted.withColumn("trust", F.col("alpha") / (F.col("alpha") + F.col("beta")))


def merge(parts: list[DataFrame], bindings: DataFrame) -> DataFrame:
    """Contributions of several sources, by name of column, under the canonical ids that their rows are bound to now."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    current = bindings.where("valid_to IS NULL").select("row_id", ID)
    return rows.join(current, "row_id")
