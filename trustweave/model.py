"""The typed model: classes with slots, the sources that feed them, and how disagreeing values are resolved."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field, replace
from enum import Enum
from typing import Any

from pyspark.sql import types as T


class ModelError(ValueError):
    """A model or an expression over it that can't be right."""


class Policy(str, Enum):
    """How one value is chosen from the contributions of several sources."""

    ARGMAX_TRUST = "argmax_trust"
    MODE = "mode"
    WEIGHTED_VOTE = "weighted_vote"
    MEDIAN_NUMERIC = "median_numeric"
    LATEST_WATERMARK = "latest_watermark"
    UNIQUE_OR_FAIL = "unique_or_fail"


#: Base types by name. Fixed values.
BASE_TYPES: dict[str, T.DataType] = {
    "string": T.StringType(),
    "integer": T.LongType(),
    "float": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "datetime": T.TimestampNTZType(),
    "bytes": T.BinaryType(),
    "uri": T.StringType(),
}
NUMERIC = ("integer", "float")


@dataclass(frozen=True)
class TypeDef:
    """A base type under a name of its own, with a pattern that its text must match."""

    name: str
    base: str
    pattern: str | None = None
    description: str = ""


@dataclass(frozen=True)
class DirectRef:
    """A foreign key: the slot holds the identifier of ``target``."""

    target: str


@dataclass(frozen=True)
class DiscriminatedRef:
    """A foreign key whose target class is named by another slot."""

    class_slot: str
    targets: tuple[str, ...]


@dataclass(frozen=True)
class PolymorphicRef:
    """A foreign key into the first of several classes that has it."""

    candidates: tuple[str, ...]


Reference = DirectRef | DiscriminatedRef | PolymorphicRef


@dataclass(frozen=True)
class Slot:
    """A typed attribute or foreign key of a class.

    ``range`` names a base type, a TypeDef, or a class for a foreign key.
    """

    name: str
    range: str = "string"
    identifier: bool = False
    required: bool = False
    multivalued: bool = False
    minimum: Any = None
    maximum: Any = None
    pattern: str | None = None
    permissible: tuple[str, ...] = ()
    policy: Policy = Policy.ARGMAX_TRUST
    reference: Reference | None = None
    derivation: Any = None
    description: str = ""


@dataclass(frozen=True)
class OntologyClass:
    name: str
    slots: tuple[Slot, ...] = ()
    is_a: str | None = None
    mixins: tuple[str, ...] = ()
    abstract: bool = False
    #: (class slot, key slot) of a class whose rows identify rows of other classes.
    identifier_pattern: tuple[str, str] | None = None
    #: Changes to inherited slots, by name: {"title": {"required": True}}.
    overrides: dict[str, dict[str, Any]] = field(default_factory=dict, hash=False)
    #: Conditions that every row must satisfy, by rule name.
    constraints: dict[str, Any] = field(default_factory=dict, hash=False)
    unique_keys: tuple[tuple[str, ...], ...] = ()
    description: str = ""


@dataclass(frozen=True)
class Source:
    """A feed of rows for one class, or, with a discriminator, for several.

    ``mapping`` takes slots to source columns; ``trust`` is the default weight and ``slot_trust`` overrides it;
    ``routes`` takes discriminator values to class names, None meaning that such rows are dropped, and "*" standing for
    all other values.
    """

    name: str
    entity: str
    identifier: str
    location: str | None = None
    format: str = "csv"
    mapping: dict[str, str] = field(default_factory=dict, hash=False)
    trust: float = 0.5
    slot_trust: dict[str, float] = field(default_factory=dict, hash=False)
    discriminator: str | None = None
    routes: dict[str, str | None] = field(default_factory=dict, hash=False)
    watermark: str | None = None
    on_missing_identifier: str = "drop"


@dataclass(frozen=True)
class Spec:
    """Root of a model."""

    classes: tuple[OntologyClass, ...]
    sources: tuple[Source, ...] = ()
    types: tuple[TypeDef, ...] = ()
    author: str = ""
    label: str = ""
    created_at: str = ""

    def __post_init__(self) -> None:
        for kind, names in (("class", [c.name for c in self.classes]), ("source", [s.name for s in self.sources]), ("type", [t.name for t in self.types])):
            if len(set(names)) != len(names):
                raise ModelError(f"{kind} names must be unique")

    def cls(self, name: str) -> OntologyClass:
        for c in self.classes:
            if c.name == name:
                return c
        raise ModelError(f"no class {name!r}")

    def is_class(self, name: str) -> bool:
        return any(c.name == name for c in self.classes)

    def source(self, name: str) -> Source:
        for s in self.sources:
            if s.name == name:
                return s
        raise ModelError(f"no source {name!r}")

    def chain(self, name: str) -> list[OntologyClass]:
        """The class, then breadth-first what it is and mixes in, each once."""
        seen: list[OntologyClass] = []
        todo = deque([name])
        while todo:
            c = self.cls(todo.popleft())
            if c not in seen:
                seen.append(c)
                todo.extend(([c.is_a] if c.is_a else []) + list(c.mixins))
        return seen

    def slots(self, name: str) -> list[Slot]:
        """Own and inherited slots; the nearest of a name counts, with the overrides of classes nearer still."""
        found: dict[str, Slot] = {}
        changes: dict[str, dict[str, Any]] = {}
        for c in self.chain(name):
            for s in c.slots:
                if s.name not in found:
                    found[s.name] = replace(s, **changes.get(s.name, {}))
            for slot, change in c.overrides.items():
                changes[slot] = {**change, **changes.get(slot, {})}
        return list(found.values())

    def slot(self, cls: str, name: str) -> Slot:
        for s in self.slots(cls):
            if s.name == name:
                return s
        raise ModelError(f"class {cls!r} has no slot {name!r}")

    def identifier(self, cls: str) -> Slot:
        for s in self.slots(cls):
            if s.identifier:
                return s
        raise ModelError(f"class {cls!r} has no identifier")

    def is_kind_of(self, name: str, ancestor: str) -> bool:
        return any(c.name == ancestor for c in self.chain(name))

    def descendants(self, name: str) -> list[str]:
        """Classes that are this one or descend from it, in the order of the spec."""
        return [c.name for c in self.classes if self.is_kind_of(c.name, name)]

    def base_type(self, slot: Slot) -> str:
        """The base type of a slot; a foreign key has that of its target's identifier."""
        if slot.range in BASE_TYPES:
            return slot.range
        for t in self.types:
            if t.name == slot.range:
                return t.base
        if self.is_class(slot.range):
            return self.base_type(self.identifier(slot.range))
        raise ModelError(f"slot {slot.name!r} has the unknown range {slot.range!r}")

    def pattern(self, slot: Slot) -> str | None:
        return slot.pattern or next((t.pattern for t in self.types if t.name == slot.range), None)

    def schema(self, cls: str) -> T.StructType:
        """Columns of the class's table: all slots that aren't derived."""
        fields = []
        for s in self.slots(cls):
            if s.derivation is None:
                kind = BASE_TYPES[self.base_type(s)]
                note = {"policy": s.policy.value, "identifier": s.identifier, "required": s.required}
                fields.append(T.StructField(s.name, T.ArrayType(kind) if s.multivalued else kind, True, note))
        return T.StructType(fields)

    def trust(self, source: str, slot: str) -> float:
        s = self.source(source)
        return s.slot_trust.get(slot, s.trust)
