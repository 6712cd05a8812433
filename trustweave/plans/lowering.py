"""Expressions to Columns and DataFrames.

A :class:`Graph` binds a model to one DataFrame per class. Paths become left joins, relation predicates semi and anti
joins where they stand alone and grouped left joins elsewhere, and aggregates keep owners without rows. Everything stays
a declared plan: Catalyst prunes, pushes down and picks the joins.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable
from functools import reduce
from itertools import count
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trustweave import expr as X
from trustweave.functions.text import text_of
from trustweave.model import DiscriminatedRef, ModelError, PolymorphicRef, Spec
from trustweave.operators import trust

OWNER = "_owner"


class Graph:
    """A model with its tables.

    ``frames`` hold one row for each entity (resolved values); ``contributions``, where given, one for each source row,
    with canonical_id, source, trust and asserted_at beside the slots.
    """

    def __init__(self, spec: Spec, frames: dict[str, DataFrame], contributions: dict[str, DataFrame] | None = None) -> None:
        self.spec, self.frames, self.contributions = spec, dict(frames), dict(contributions or {})
        self._names = count()

    def frame(self, cls: str) -> DataFrame:
        """Rows of a class; of one with descendants, the rows of all that have a table, by name of column."""
        if cls in self.frames:
            return self.frames[cls]
        below = [c for c in self.spec.descendants(cls) if c in self.frames]
        if not below:
            raise ModelError(f"no table for class {cls!r}")
        return self.subclasses(cls)

    def subclasses(self, cls: str) -> DataFrame:
        """All rows of the class and its descendants, with the name of each one's class."""
        below = [c for c in self.spec.descendants(cls) if c in self.frames]
        parts = [self.frames[c].withColumn("class_name", F.lit(c)) for c in below]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def key(self, cls: str) -> str:
        return self.spec.identifier(cls).name

    def _fresh(self, what: str) -> str:
        return f"_{what}{next(self._names)}"

    # Values within a row

    def where(self, cls: str, condition: X.Node, df: DataFrame | None = None) -> DataFrame:
        """Rows for which the condition is true."""
        df = self.frame(cls) if df is None else df
        if isinstance(condition, X.BoolExpr) and condition.op == "and":
            return reduce(lambda d, c: self.where(cls, c, d), condition.operands, df)
        negated = isinstance(condition, X.BoolExpr) and condition.op == "not"
        inner = condition.operands[0] if negated else condition
        if isinstance(inner, (X.RelationAny, X.RelationAll)):
            rows, some = self._matching(inner, cls)
            keep = some != negated
            return df.join(rows, df[self.key(cls)] == rows[OWNER], "left_semi" if keep else "left_anti")
        names = df.columns
        bound, column = self.bind(cls, condition, df)
        return bound.where(column).select(*names)

    def derive(self, cls: str, derived: dict[str, X.Node], df: DataFrame | None = None) -> DataFrame:
        """The rows with derived columns added; one of an old name takes its place."""
        df = self.frame(cls) if df is None else df
        names = df.columns
        added = []
        for name, n in derived.items():
            df, column = self.bind(cls, n, df)
            added.append(column.alias(name))
        return df.select(*[c for c in names if c not in derived], *added)

    def select(self, cls: str, columns: dict[str, X.Node], condition: X.Node | None = None) -> DataFrame:
        """Only the given columns, of the rows for which the condition is true; both share the joins of their paths."""
        df, tests = self.frame(cls), []
        parts = condition.operands if isinstance(condition, X.BoolExpr) and condition.op == "and" else [] if condition is None else [condition]
        for part in parts:
            inner = part.operands[0] if isinstance(part, X.BoolExpr) and part.op == "not" else part
            if isinstance(inner, (X.RelationAny, X.RelationAll)):
                df = self.where(cls, part, df)
            else:
                tests.append(part)
        df, kept = self._all(cls, tuple(tests), df)
        df, made = self._all(cls, tuple(columns.values()), df)
        for test in kept:
            df = df.where(test)
        return df.select(*[c.alias(name) for name, c in zip(columns, made, strict=True)])

    def bind(self, cls: str, n: X.Node, df: DataFrame) -> tuple[DataFrame, Column]:
        """``df`` with what the expression needs joined to it, and the expression as a Column of that."""
        match n:
            case X.Literal():
                return df, literal(n.value)
            case X.ConfigRef():
                raise ModelError(f"setting {n.name!r} isn't bound")
            case X.SlotPath():
                return self._path(cls, n, df)
            case X.Scoped():
                return self._scoped(cls, n, None, df)
            case X.ScalarDerivation():
                return self.bind(cls, n.expression, df)
            case X.FormatDerivation():
                return df, self._format(cls, n, df)
            case X.BoolExpr():
                df, parts = self._all(cls, n.operands, df)
                if n.op == "not":
                    return df, ~parts[0]
                return df, reduce((lambda a, b: a & b) if n.op == "and" else (lambda a, b: a | b), parts)
            case X.Arithmetic():
                df, (a, b) = self._all(cls, (n.left, n.right), df)
                return df, {"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b)}[n.op]
            case X.Compare() | X.Within() | X.Between() | X.Matches() | X.Affix():
                if isinstance(n.left, X.Scoped):
                    return self._scoped(cls, n.left, n, df)
                df, left = self.bind(cls, n.left, df)
                return self._test(cls, n, left, df)
            case X.RelationCount() | X.RelationAggregate() | X.RelationFirst() | X.RelationAny() | X.RelationAll():
                return self._per_owner(cls, n, df)
            case X.RecursiveTraversal():
                raise ModelError("a recursive traversal has no value within a row; use closure()")
        raise ModelError(f"{type(n).__name__} has no value within a row")

    def _all(self, cls: str, nodes: tuple[X.Node, ...], df: DataFrame) -> tuple[DataFrame, list[Column]]:
        made = []
        for x in nodes:
            df, c = self.bind(cls, x, df)
            made.append(c)
        return df, made

    def _test(self, cls: str, n: X.Node, left: Column, df: DataFrame) -> tuple[DataFrame, Column]:
        match n:
            case X.Compare(op="is null"):
                return df, left.isNull()
            case X.Compare(op="is not null"):
                return df, left.isNotNull()
            case X.Compare(op="in" | "not in"):
                value = n.right.value if isinstance(n.right, X.Literal) else None
                if value is None:
                    raise ModelError(f"{n.op} takes a list of literals")
                inside = left.isin(*[literal(v) for v in (value if isinstance(value, (list, tuple, set)) else [value])])
                return df, inside if n.op == "in" else ~inside
            case X.Compare():
                df, right = self.bind(cls, n.right, df)
                return df, {"=": left == right, "<>": left != right, ">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right}[n.op]
            case X.Within():
                return df, left.isin(*[literal(v) for v in n.values])
            case X.Between():
                df, (low, high) = self._all(cls, (n.lower, n.upper), df)
                return df, left.between(low, high) if n.inclusive else (left > low) & (left < high)
            case X.Matches():
                return df, left.rlike(n.pattern) if n.is_regex else left.like(n.pattern)
            case X.Affix():
                return df, left.startswith(n.text) if n.prefix else left.endswith(n.text)
        raise ModelError(f"{type(n).__name__} is no test")

    def _path(self, cls: str, n: X.SlotPath, df: DataFrame) -> tuple[DataFrame, Column]:
        """One left join for each hop; the last slot is the value."""
        if not n.slots:
            raise ModelError("an empty path has no value within a row")
        if not (self.spec.is_kind_of(cls, n.cls) or self.spec.is_kind_of(n.cls, cls)):
            raise ModelError(f"a path from {n.cls!r} stands in an expression over {cls!r}")
        at, held = n.cls, n.slots[0]
        if held not in df.columns:
            slot = self.spec.slot(at, held)
            if slot.derivation is None:
                raise ModelError(f"the table of {cls!r} lacks the slot {held!r}")
            df, column = self.bind(cls, slot.derivation, df)
            held = self._fresh("derived")
            df = df.withColumn(held, column)
        for i, name in enumerate(n.slots[:-1]):
            # Named by its path, so that an expression which holds a path twice joins it once.
            df, at, held = self._hop(df, at, name, held, n.slots[i + 1], "_".join(["_hop", n.cls, *n.slots[: i + 2]]))
        return df, F.col(f"`{held}`")

    def _hop(self, df: DataFrame, cls: str, name: str, held: str, following: str, new: str) -> tuple[DataFrame, str, str]:
        slot = self.spec.slot(cls, name)
        there_already = new in df.columns
        if isinstance(slot.reference, PolymorphicRef):
            if there_already:
                return df, slot.reference.candidates[0], new
            found = []
            for target in slot.reference.candidates:
                there, key, value = self.frame(target), self._fresh("key"), self._fresh("hop")
                df = df.join(there.select(F.col(self.key(target)).alias(key), F.col(following).alias(value)), df[held] == F.col(key), "left")
                found.append(F.when(F.col(key).isNotNull(), F.struct(F.col(value).alias("v"))))
            return df.withColumn(new, F.coalesce(*found)["v"]), slot.reference.candidates[0], new
        if isinstance(slot.reference, DiscriminatedRef):
            if there_already:
                return df, slot.reference.targets[0], new
            there = self.tagged(slot.reference.targets, following)
            kind, key = self._fresh("kind"), self._fresh("key")
            there = there.select(F.col("entity_class").alias(kind), F.col("entity_key").alias(key), F.col("value").alias(new))
            return df.join(there, (df[slot.reference.class_slot] == F.col(kind)) & (df[held].cast("string") == F.col(key)), "left"), slot.reference.targets[0], new
        target = slot.range
        if not self.spec.is_class(target):
            raise ModelError(f"slot {name!r} of {cls!r} leads nowhere")
        if there_already:
            return df, target, new
        key = self._fresh("key")
        there = self.frame(target)
        return df.join(there.select(F.col(self.key(target)).alias(key), F.col(following).alias(new)), df[held] == F.col(key), "left"), target, new

    def tagged(self, classes: tuple[str, ...], slot: str) -> DataFrame:
        """(entity_class, entity_key, value) over several classes, for keys that name their class."""
        parts = [self.frame(c).select(F.lit(c).alias("entity_class"), F.col(self.key(c)).cast("string").alias("entity_key"), F.col(slot).alias("value")) for c in classes]
        return reduce(DataFrame.unionByName, parts)

    def _format(self, cls: str, n: X.FormatDerivation, df: DataFrame) -> Column:
        parts = []
        for fixed, name in re.findall(r"([^{}]*)(?:\{(\w+)\})?", n.template):
            if fixed:
                parts.append(F.lit(fixed))
            if name:
                self.spec.slot(cls, name)
                parts.append(F.coalesce(text_of(df, name), F.lit("")))
        return F.concat(*parts) if parts else F.lit("")

    # Contributions of several sources

    def _scoped(self, cls: str, n: X.Scoped, test: X.Node | None, df: DataFrame) -> tuple[DataFrame, Column]:
        """Values or tests over the contributions, joined by the owner's identifier."""
        if cls not in self.contributions:
            raise ModelError(f"class {cls!r} has no contributions")
        rows, slot = self.contributions[cls], n.path.slots[-1]
        if n.until is not None:
            rows = rows.where(F.col("asserted_at") <= literal(n.until))
        if n.how == "winner":
            per = trust.resolve(rows, slot, self.spec.slot(cls, slot).policy)
        elif n.how == "contributions":
            per = trust.contribution_list(rows, slot)
        elif n.how == "source":
            mine = rows.where(F.col("source") == n.source)
            if isinstance(test, X.Compare) and test.op == "is null":
                per = mine.groupBy("canonical_id").agg(F.bool_and(F.col(slot).isNull()).alias(slot))
                test = None
            else:
                per = trust.resolve(mine, slot)
        elif n.how in ("all", "any") and test is not None:
            _, column = self._test(cls, test, F.col(slot), rows)
            per = trust.every(rows, slot, column) if n.how == "all" else trust.some(rows, slot, column)
            test = None
        else:
            raise ModelError(f"{n.how}_() needs a test")
        key, value = self._fresh("key"), self._fresh("scoped")
        df = df.join(per.select(F.col("canonical_id").alias(key), F.col(slot).alias(value)), df[self.key(cls)] == F.col(key), "left")
        return (df, F.col(value)) if test is None else self._test(cls, test, F.col(value), df)

    # Relations

    def relation(self, n: X.Relation, owner: str) -> DataFrame:
        """Rows of the relation with the identifier of their owner in the column ``_owner``."""
        match n:
            case X.Scan():
                return self.frame(n.cls)
            case X.FilteredRelation():
                return self.where(self.target(n.relation, owner), n.condition, self.relation(n.relation, owner))
            case X.RelationProject():
                rows = self.relation(n.relation, owner)
                return rows.select(*([OWNER] if OWNER in rows.columns else []), *n.slots)
            case X.RelationRef():
                slot = self.spec.slot(n.from_class, n.slot)
                if self.spec.is_class(slot.range) and self.spec.is_kind_of(owner, slot.range):
                    rows = self.frame(n.from_class)
                    return rows.where(F.col(n.slot).isNotNull()).withColumn(OWNER, F.col(n.slot))
                if n.from_class == owner and self.spec.is_class(slot.range):
                    own = self.frame(owner).select(F.col(self.key(owner)).alias(OWNER), F.col(n.slot).alias("_to"))
                    there = self.frame(slot.range)
                    return own.join(there, own["_to"] == there[self.key(slot.range)]).drop("_to")
                raise ModelError(f"{n.from_class}.{n.slot} leads neither to nor from {owner!r}")
        raise ModelError(f"{type(n).__name__} is no relation")

    def target(self, n: X.Relation, owner: str) -> str:
        """The class of the relation's rows."""
        match n:
            case X.Scan():
                return n.cls
            case X.FilteredRelation() | X.RelationProject():
                return self.target(n.relation, owner)
            case X.RelationRef():
                slot = self.spec.slot(n.from_class, n.slot)
                forward = n.from_class == owner and not (self.spec.is_class(slot.range) and self.spec.is_kind_of(owner, slot.range))
                return slot.range if forward else n.from_class
        raise ModelError(f"{type(n).__name__} is no relation")

    def _matching(self, n: X.Node, owner: str) -> tuple[DataFrame, bool]:
        """Owners with a row that decides, and whether having one makes the predicate true."""
        rows, to = self.relation(n.relation, owner), self.target(n.relation, owner)
        if isinstance(n, X.RelationAny):
            return (rows if n.condition is None else self.where(to, n.condition, rows)).select(OWNER), True
        if n.condition is not None:
            rows, column = self.bind(to, n.condition, rows)
            rows = rows.where(~F.coalesce(column, F.lit(False)))
        return rows.select(OWNER), False

    def _per_owner(self, cls: str, n: X.Node, df: DataFrame) -> tuple[DataFrame, Column]:
        value, key = self._fresh("per"), self._fresh("key")
        if isinstance(n, (X.RelationAny, X.RelationAll)):
            rows, some = self._matching(n, cls)
            per = rows.distinct().select(F.col(OWNER).alias(key))
            df = df.join(per, df[self.key(cls)] == F.col(key), "left")
            return df, F.col(key).isNotNull() if some else F.col(key).isNull()
        per = self.aggregate(n, cls)
        if "source" in per.columns or len(per.columns) != 2:
            raise ModelError("grouped by source or pivoted it has no single value; use aggregate()")
        per = per.select(F.col(OWNER).alias(key), F.col(per.columns[1]).alias(value))
        df = df.join(per, df[self.key(cls)] == F.col(key), "left")
        counts = isinstance(n, X.RelationCount) or n.function == X.Agg.COUNT if not isinstance(n, X.RelationFirst) else False
        return df, F.coalesce(F.col(value), F.lit(0)) if counts else F.col(value)

    def aggregate(self, n: X.Node, owner: str) -> DataFrame:
        """``_owner`` and value (with the source, or one column for each pivoted source), for owners with rows."""
        rows = self.relation(n.relation, owner)
        match n:
            case X.RelationCount():
                return (rows.distinct() if n.distinct else rows).groupBy(OWNER).agg(F.count("*").alias("value"))
            case X.RelationFirst():
                if n.assert_unique:
                    several = rows.groupBy(OWNER).count().where("count > 1").limit(1).collect()
                    if several:
                        raise ModelError(f"{owner} {several[0][0]!r} has {several[0][1]} rows where one at most is allowed")
                columns = [c for c in rows.columns if c != OWNER]
                order = [F.col(c).asc_nulls_last() for c in n.order_by] + [F.col(c).asc_nulls_last() for c in columns if c not in n.order_by]
                ranked = rows.withColumn("_place", F.row_number().over(Window.partitionBy(OWNER).orderBy(*order)))
                return ranked.where("_place = 1").select(OWNER, F.struct(*columns).alias("value"))
            case X.RelationAggregate():
                function = aggregate_function(n)
                if n.pivot:
                    return rows.groupBy(OWNER).pivot("source", list(n.pivot)).agg(function)
                grouped = rows.groupBy(OWNER, "source") if n.group_by == X.GroupBy.SOURCE else rows.groupBy(OWNER)
                return grouped.agg(function.alias("value"))
        raise ModelError(f"{type(n).__name__} is no aggregate")

    def by_source(self, n: X.RelationAggregate, owner: str) -> DataFrame:
        """``_owner`` and a map from each source to its value."""
        per = self.aggregate(X.replace(n, group_by=X.GroupBy.SOURCE, pivot=()), owner)
        return per.groupBy(OWNER).agg(F.map_from_entries(F.collect_list(F.struct("source", "value"))).alias("value"))

    def edges(self, cls: str, n: X.EdgeDerivation) -> DataFrame:
        """Distinct (src_id, dst_id) of a derived edge."""
        to = self.target(n.relation, cls)
        rows = self.relation(n.relation, cls)
        there = n.target or self.key(to)
        return rows.select(F.col(OWNER).alias("src_id"), F.col(there).alias("dst_id")).where("dst_id IS NOT NULL").distinct()

    def closure(self, cls: str, n: X.RecursiveTraversal) -> DataFrame:
        """(src_id, dst_id, depth) over up to ``max_depth`` steps of a relation that leads back to the class; shortest depth."""
        to = self.target(n.step, cls)
        if to != cls:
            raise ModelError("a traversal needs a relation from a class to itself")
        step = self.relation(n.step, cls).select(F.col(OWNER).alias("src_id"), F.col(self.key(cls)).alias("dst_id")).distinct()
        hop = step.select(F.col("src_id").alias("dst_id"), F.col("dst_id").alias("next"))
        found, last = step.withColumn("depth", F.lit(1)), step
        for depth in range(2, n.max_depth + 1):
            last = last.join(hop, "dst_id").select("src_id", F.col("next").alias("dst_id")).distinct()
            found = found.union(last.withColumn("depth", F.lit(depth)))
        return found.groupBy("src_id", "dst_id").agg(F.min("depth").alias("depth"))

    def include(self, cls: str, paths: dict[str, X.SlotPath], collected: dict[str, X.RelationAggregate] | None = None) -> DataFrame:
        """Slots of related rows beside each row, and lists collected over relations, one row for each primary row."""
        return self.derive(cls, {**paths, **(collected or {})})

    def include_rows(self, cls: str, relation: X.Relation, prefix: str) -> DataFrame:
        """Each row beside each of its related rows, whose columns are prefixed; rows without any stay."""
        rows = self.relation(relation, cls)
        renamed = rows.select(F.col(OWNER).alias("_to"), *[F.col(c).alias(f"{prefix}_{c}") for c in rows.columns if c != OWNER])
        own = self.frame(cls)
        return own.join(renamed, own[self.key(cls)] == F.col("_to"), "left").drop("_to")


def literal(value: Any) -> Column:
    """A literal, typed by its Python type; naive datetimes are without time zone."""
    if isinstance(value, datetime.datetime):
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(value)


def aggregate_function(n: X.RelationAggregate) -> Column:
    v = F.col(n.slot)
    plain: dict[X.Agg, Callable[[Column], Column]] = {X.Agg.SUM: F.sum, X.Agg.AVG: F.avg, X.Agg.MIN: F.min, X.Agg.MAX: F.max}
    order = F.struct(*([F.col(n.order_by)] if n.order_by else []), v)
    match n.function:
        case X.Agg.COUNT:
            return F.countDistinct(v) if n.distinct else F.count(v)
        case X.Agg.SUM if n.distinct:
            return F.sum_distinct(v)
        case X.Agg.AVG if n.distinct:
            return F.expr(f"avg(DISTINCT `{n.slot}`)")
        case X.Agg.COLLECT if n.order_by:
            entry = F.when(v.isNotNull(), F.struct(F.col(n.order_by).alias("k"), v.alias("v")))
            return F.transform(F.array_sort(F.collect_set(entry) if n.distinct else F.collect_list(entry)), lambda x: x["v"])
        case X.Agg.COLLECT:
            return F.sort_array(F.collect_set(v) if n.distinct else F.collect_list(v))
        case X.Agg.FIRST:
            return F.min_by(v, F.when(v.isNotNull(), order))
    return plain[n.function](v)
