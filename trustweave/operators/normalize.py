"""Source rows to per-source facts: mapped, typed, routed, and with those that don't conform set apart."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustweave.functions import text
from trustweave.model import BASE_TYPES, ModelError, Slot, Source, Spec


@dataclass
class Normalized:
    """Facts by class, and rows set apart with the reason."""

    facts: dict[str, DataFrame]
    rejected: DataFrame


def typed(spec: Spec, slot: Slot, c: Column) -> Column:
    """A text cell as the slot's type; what can't be read is null, and an empty cell is null."""
    cell = F.nullif(text.clean(c.cast("string")), F.lit(""))
    kind = spec.base_type(slot)
    if slot.permissible:
        folded = text.fold(cell)
        match = F.lit(None).cast("string")
        for value in slot.permissible:
            match = F.when(folded == value.lower(), F.lit(value)).otherwise(match)
        cell = F.coalesce(match, cell)
    if slot.multivalued:
        parts = text.parse_list(cell)
        return F.when(cell.isNotNull(), parts if kind in ("string", "uri") else F.transform(parts, lambda x: x.try_cast(BASE_TYPES[kind])))
    if kind == "date":
        return text.parse_date(cell)
    if kind == "string":
        return text.hyphens(cell)
    return cell.try_cast(BASE_TYPES[kind])


def row_id(source: Column, key: Column) -> Column:
    """The same for the same source row, in every run."""
    return F.sha2(F.concat_ws("|", source, key.cast("string")), 256)


def map_fields(spec: Spec, source: Source, cls: str, rows: DataFrame) -> DataFrame:
    """Slots of the class from the source's columns; absent ones are null."""
    columns = []
    for slot in spec.slots(cls):
        if slot.derivation is not None:
            continue
        name = source.mapping.get(slot.name, slot.name)
        value = typed(spec, slot, F.col(name)) if name in rows.columns else F.lit(None).cast(spec.schema(cls)[slot.name].dataType)
        columns.append(value.alias(slot.name))
    return rows.select(*[c for c in ("_route",) if c in rows.columns], F.col(source.identifier).cast("string").alias("src_key"), _asserted(source, rows), *columns)


def _asserted(source: Source, rows: DataFrame) -> Column:
    held = F.col(source.watermark).try_cast("timestamp_ntz") if source.watermark else F.lit(None).cast("timestamp_ntz")
    return held.alias("asserted_at")


def route(source: Source, rows: DataFrame) -> DataFrame:
    """Add the class that a row goes to, by its discriminator: null for rows that are dropped.

    A value without a route is an error, unless "*" says what becomes of all others.
    """
    if source.discriminator is None:
        return rows.withColumn("_route", F.lit(source.entity))
    value = text.fold(F.col(source.discriminator).cast("string"))
    known = [v.lower() for v in source.routes if v != "*"]
    if "*" not in source.routes:
        unknown = rows.where(value.isNull() | ~value.isin(known)).select(F.col(source.discriminator).cast("string")).limit(1).collect()
        if unknown:
            raise ModelError(f"source {source.name!r}: no route for {source.discriminator} = {unknown[0][0]!r}")
    target = F.lit(source.routes.get("*")).cast("string")
    for v, cls in source.routes.items():
        if v != "*":
            target = F.when(value == v.lower(), F.lit(cls).cast("string")).otherwise(target)
    return rows.withColumn("_route", target)


def normalize(spec: Spec, source: Source, rows: DataFrame) -> Normalized:
    """Per-source facts for each class that the source feeds: source, src_key, row_id, asserted_at and the slots."""
    routed = route(source, rows)
    classes = sorted({c for c in source.routes.values() if c} if source.discriminator else {source.entity})
    facts, rejected = {}, []
    for cls in classes:
        mapped = map_fields(spec, source, cls, routed.where(F.col("_route") == cls)).drop("_route")
        missing = F.coalesce(F.trim("src_key"), F.lit("")) == ""
        if source.on_missing_identifier == "fail" and mapped.where(missing).limit(1).count():
            raise ModelError(f"source {source.name!r}: a row of {cls!r} has no identifier")
        required = [s.name for s in spec.slots(cls) if s.required and not s.identifier and s.derivation is None]
        lacking = F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in required])) if required else F.array().cast("array<string>")
        reason = F.when(missing, F.lit("missing identifier")).when(F.size(lacking) > 0, F.concat(F.lit("missing "), F.array_join(lacking, ", ")))
        judged = mapped.withColumn("_reason", reason)
        slots = [c for c in mapped.columns if c not in ("src_key", "asserted_at")]
        good = judged.where("_reason IS NULL")
        name = F.lit(source.name)
        facts[cls] = good.select(name.alias("source"), "src_key", row_id(name, F.col("src_key")).alias("row_id"), "asserted_at", *slots)
        rejected.append(judged.where("_reason IS NOT NULL").select(name.alias("source"), F.lit(cls).alias("class_name"), "src_key", F.col("_reason").alias("reason")))
    apart = rejected[0]
    for r in rejected[1:]:
        apart = apart.union(r)
    return Normalized(facts, apart)
