"""Expressions over a model: predicates, relations, aggregates and derivations, as plain trees.

Comparison operators of Python build nodes: ``path("Order", "total") > 5``. A node is lowered to Columns and DataFrames
by :mod:`trustweave.plans.lowering`; nothing here touches Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields, is_dataclass, replace
from enum import Enum
from typing import Any

from trustweave.model import ModelError

COMPARISONS = ("=", "<>", ">", ">=", "<", "<=", "in", "not in", "is null", "is not null")


class Agg(str, Enum):
    COUNT = "count"
    SUM = "sum"
    AVG = "avg"
    MIN = "min"
    MAX = "max"
    COLLECT = "collect"
    FIRST = "first"


class GroupBy(str, Enum):
    NONE = "none"
    SOURCE = "source"


class Node:
    """Base of all expressions; equality of nodes is by identity, as ``==`` builds a comparison."""

    __hash__ = object.__hash__

    def _compare(self, op: str, other: Any = None) -> Compare:
        return Compare(op, self, other if op.startswith("is") else as_node(other))

    def __eq__(self, other: Any) -> Compare:  # type: ignore[override]
        return self._compare("=", other)

    def __ne__(self, other: Any) -> Compare:  # type: ignore[override]
        return self._compare("<>", other)

    def __gt__(self, other: Any) -> Compare:
        return self._compare(">", other)

    def __ge__(self, other: Any) -> Compare:
        return self._compare(">=", other)

    def __lt__(self, other: Any) -> Compare:
        return self._compare("<", other)

    def __le__(self, other: Any) -> Compare:
        return self._compare("<=", other)

    def __and__(self, other: Node) -> BoolExpr:
        return BoolExpr("and", (self, other))

    def __or__(self, other: Node) -> BoolExpr:
        return BoolExpr("or", (self, other))

    def __invert__(self) -> BoolExpr:
        return BoolExpr("not", (self,))

    def __bool__(self) -> bool:
        raise ModelError("an expression has no truth value; use & | ~")

    def __add__(self, other: Any) -> Arithmetic:
        return Arithmetic("+", self, as_node(other))

    def __sub__(self, other: Any) -> Arithmetic:
        return Arithmetic("-", self, as_node(other))

    def __mul__(self, other: Any) -> Arithmetic:
        return Arithmetic("*", self, as_node(other))

    def __truediv__(self, other: Any) -> Arithmetic:
        return Arithmetic("/", self, as_node(other))

    def is_null(self) -> Compare:
        return self._compare("is null")

    def is_not_null(self) -> Compare:
        return self._compare("is not null")

    def isin(self, values: list) -> Compare:
        return self._compare("in", list(values))

    def not_in(self, values: list) -> Compare:
        return self._compare("not in", list(values))

    def within(self, values: list) -> Within:
        return Within(self, tuple(values))

    def between(self, lower: Any, upper: Any, inclusive: bool = True) -> Between:
        return Between(self, as_node(lower), as_node(upper), inclusive)

    def matches(self, pattern: str) -> Matches:
        return Matches(self, pattern)

    def starts_with(self, text: str) -> Affix:
        return Affix(self, text, True)

    def ends_with(self, text: str) -> Affix:
        return Affix(self, text, False)


def node(cls: type) -> type:
    return dataclass(frozen=True, eq=False)(cls)


def as_node(value: Any) -> Node:
    return value if isinstance(value, Node) else Literal(value)


@node
class Literal(Node):
    value: Any


@node
class ConfigRef(Node):
    """A named setting, replaced by its value before lowering."""

    name: str


@node
class SlotPath(Node):
    """A slot of the class at hand, or one reached over foreign keys; each hop is a left join."""

    cls: str
    slots: tuple[str, ...]

    def __getattr__(self, name: str) -> SlotPath:
        if name.startswith("_"):
            raise AttributeError(name)
        return SlotPath(self.cls, (*self.slots, name))

    def from_source(self, source: str) -> Scoped:
        return Scoped(self, "source", source)

    def all_(self) -> Scoped:
        return Scoped(self, "all")

    def any_(self) -> Scoped:
        return Scoped(self, "any")

    def winner(self) -> Scoped:
        return Scoped(self, "winner")

    def contributions(self) -> Scoped:
        return Scoped(self, "contributions")


@node
class Scoped(Node):
    """A slot seen as the contributions of its sources: of one source, all, any, the winner's, or as a list.

    ``until`` keeps contributions asserted up to then only.
    """

    path: SlotPath
    how: str
    source: str | None = None
    until: Any = None

    def as_of(self, moment: Any) -> Scoped:
        return replace(self, until=moment)


@node
class Compare(Node):
    op: str
    left: Node
    right: Node | None = None

    def __post_init__(self) -> None:
        if self.op not in COMPARISONS:
            raise ModelError(f"unknown comparison {self.op!r}")


@node
class BoolExpr(Node):
    op: str
    operands: tuple[Node, ...]

    def __post_init__(self) -> None:
        if self.op not in ("and", "or", "not"):
            raise ModelError(f"unknown connective {self.op!r}")
        if self.op == "not" and len(self.operands) != 1:
            raise ModelError("not takes one operand")


@node
class Arithmetic(Node):
    op: str
    left: Node
    right: Node


@node
class Within(Node):
    left: Node
    values: tuple


@node
class Between(Node):
    left: Node
    lower: Node
    upper: Node
    inclusive: bool = True


@node
class Matches(Node):
    """LIKE, or a regular expression if the pattern holds any sign that only those have."""

    left: Node
    pattern: str

    @property
    def is_regex(self) -> bool:
        return any(sign in self.pattern for sign in "^$.*+?{}[]|()\\")


@node
class Affix(Node):
    left: Node
    text: str
    prefix: bool


class Relation(Node):
    """Rows of another class that belong to each row of an owner."""

    def where(self, condition: Node) -> FilteredRelation:
        return FilteredRelation(self, condition)

    def select(self, *slots: str) -> RelationProject:
        return RelationProject(self, slots)

    def count(self, distinct: bool = False) -> RelationCount:
        return RelationCount(self, distinct)

    def agg(self, function: Agg | str, slot: str, **options: Any) -> RelationAggregate:
        return RelationAggregate(self, Agg(function), slot, **options)

    def collect(self, slot: str, order_by: str | None = None) -> RelationAggregate:
        return RelationAggregate(self, Agg.COLLECT, slot, order_by=order_by)

    def group_by_source(self, slot: str) -> RelationAggregate:
        return RelationAggregate(self, Agg.COLLECT, slot, group_by=GroupBy.SOURCE)

    def any_(self, condition: Node | None = None) -> RelationAny:
        return RelationAny(self, condition)

    def all_(self, condition: Node | None = None) -> RelationAll:
        return RelationAll(self, condition)

    def first(self, *order_by: str, assert_unique: bool = False) -> RelationFirst:
        return RelationFirst(self, order_by, assert_unique)

    def transitive(self, max_depth: int) -> RecursiveTraversal:
        return RecursiveTraversal(self, max_depth)


@node
class RelationRef(Relation):
    """``slot`` of ``from_class`` is the foreign key: to the owner (its rows belong to it) or of the owner (its target)."""

    from_class: str
    slot: str


@node
class Scan(Relation):
    """All rows of a class, whatever the owner."""

    cls: str


@node
class FilteredRelation(Relation):
    relation: Relation
    condition: Node


@node
class RelationProject(Relation):
    relation: Relation
    slots: tuple[str, ...]


@node
class RelationCount(Node):
    relation: Relation
    distinct: bool = False


@node
class RelationAggregate(Node):
    relation: Relation
    function: Agg
    slot: str
    distinct: bool = False
    order_by: str | None = None
    group_by: GroupBy = GroupBy.NONE
    pivot: tuple[str, ...] = ()


@node
class RelationAny(Node):
    relation: Relation
    condition: Node | None = None


@node
class RelationAll(Node):
    """True where the condition provably holds for every row; without one, where there is no row."""

    relation: Relation
    condition: Node | None = None


@node
class RelationFirst(Node):
    relation: Relation
    order_by: tuple[str, ...]
    assert_unique: bool = False


@node
class RecursiveTraversal(Node):
    """Everything reached over a relation in any number of steps; not allowed in derivations."""

    step: Relation
    max_depth: int


@node
class ScalarDerivation(Node):
    """A value computed within a row."""

    expression: Node


@node
class FormatDerivation(Node):
    """A text with slots filled in by name: ``"{title} ({year})"``."""

    template: str


@node
class EdgeDerivation(Node):
    """An edge from each row of the class to each of the relation's rows, or to what their slot ``target`` names."""

    relation: Relation
    target: str | None = None


def path(cls: str, *slots: str) -> SlotPath:
    return SlotPath(cls, slots)


def children(n: Any) -> Iterator[Node]:
    """The nodes directly below."""
    if not is_dataclass(n):
        return
    for f in fields(n):
        v = getattr(n, f.name)
        for x in v if isinstance(v, tuple) else (v,):
            if isinstance(x, Node):
                yield x


def walk(n: Node) -> Iterator[Node]:
    """The node and all below it, from the top."""
    yield n
    for c in children(n):
        yield from walk(c)


def rewrite(n: Node, change: Callable[[Node], Node]) -> Node:
    """The tree with ``change`` applied to each node, from the bottom; unchanged parts are kept."""
    new = {}
    for f in fields(n):  # type: ignore[arg-type]
        v = getattr(n, f.name)
        if isinstance(v, Node):
            w = rewrite(v, change)
        elif isinstance(v, tuple) and any(isinstance(x, Node) for x in v):
            w = tuple(rewrite(x, change) if isinstance(x, Node) else x for x in v)
            w = v if all(a is b for a, b in zip(v, w, strict=True)) else w
        else:
            continue
        if w is not v:
            new[f.name] = w
    return change(replace(n, **new) if new else n)


def bind_config(n: Node, config: dict[str, Any]) -> Node:
    """Settings replaced by their values; one that isn't set is an error."""

    def change(x: Node) -> Node:
        if isinstance(x, ConfigRef):
            if x.name not in config:
                raise ModelError(f"no setting {x.name!r}")
            return Literal(config[x.name])
        return x

    return rewrite(n, change)
