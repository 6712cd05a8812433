"""What refers to what in a model: impact of edits, differences between versions, checks of names, walks back from facts."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustweave import expr as X
from trustweave.model import DirectRef, DiscriminatedRef, ModelError, Policy, PolymorphicRef, Spec
from trustweave.plans.canonical import RUNTIME, dump

#: Edits whose impact can be asked for. Fixed values.
EDITS = (
    "rename_slot", "add_slot", "delete_slot", "change_resolution_policy", "add_class", "remove_class", "rename_class",
    "change_superclass", "add_source", "add_derivation",
)
#: More edits, which only this engine names.
MORE_EDITS = ("change_range", "change_cardinality", "add_constraint", "remove_source", "change_trust")
#: Policies in which trust never counts.
UNWEIGHED = (Policy.MEDIAN_NUMERIC, Policy.UNIQUE_OR_FAIL)


@dataclass(frozen=True, order=True)
class Ref:
    """A class, or a slot of one, and what refers to it."""

    cls: str
    slot: str | None
    by: str


def expression_refs(spec: Spec, n: X.Node, by: str) -> set[Ref]:
    found = set()
    for x in X.walk(n):
        if isinstance(x, X.SlotPath):
            at = x.cls
            found.add(Ref(at, None, by))
            for i, name in enumerate(x.slots):
                found.add(Ref(at, name, by))
                s = spec.slot(at, name)
                if i + 1 < len(x.slots):
                    at = s.range if spec.is_class(s.range) else s.reference.candidates[0] if isinstance(s.reference, PolymorphicRef) else s.reference.targets[0] if isinstance(s.reference, DiscriminatedRef) else at
                    found.add(Ref(at, None, by))
        elif isinstance(x, X.RelationRef):
            found |= {Ref(x.from_class, None, by), Ref(x.from_class, x.slot, by)}
        elif isinstance(x, X.Scan):
            found.add(Ref(x.cls, None, by))
    return found


def references(spec: Spec) -> set[Ref]:
    """Everything in a model that refers to a class or slot."""
    found: set[Ref] = set()
    for c in spec.classes:
        for other in ([c.is_a] if c.is_a else []) + list(c.mixins):
            found.add(Ref(other, None, f"class:{c.name}"))
        for s in c.slots:
            by = f"slot:{c.name}.{s.name}"
            if spec.is_class(s.range):
                found.add(Ref(s.range, None, by))
            targets: Iterable[str] = ()
            match s.reference:
                case DirectRef():
                    targets = (s.reference.target,)
                case DiscriminatedRef():
                    targets = s.reference.targets
                    found.add(Ref(c.name, s.reference.class_slot, by))
                case PolymorphicRef():
                    targets = s.reference.candidates
            found |= {Ref(t, None, by) for t in targets}
            if s.derivation is not None:
                found |= expression_refs(spec, s.derivation, by)
        for rule, body in c.constraints.items():
            found |= expression_refs(spec, body, f"constraint:{c.name}.{rule}")
    for s in spec.sources:
        by = f"source:{s.name}"
        for cls in {s.entity, *[c for c in s.routes.values() if c]}:
            found.add(Ref(cls, None, by))
            known = {x.name for x in spec.slots(cls)}
            found |= {Ref(cls, slot, by) for slot in {*s.mapping, *s.slot_trust} if slot in known}
    return found


@dataclass(frozen=True)
class Bound:
    """An implementation: the kind of stage and the class it is bound to, its path, and the (class, slot) that it reads."""

    kind: str
    cls: str
    path: str
    reads: tuple[tuple[str, str | None], ...] = ()


@dataclass(frozen=True)
class Impact:
    """What an edit touches, each in order of name: classes, what refers to them, implementations and their classes."""

    classes: tuple[str, ...]
    refs: tuple[str, ...]
    implementations: tuple[str, ...] = ()
    workflows: tuple[str, ...] = ()


def impact(
    spec: Spec,
    edit: str,
    cls: str | None = None,
    slot: str | None = None,
    source: str | None = None,
    parent: str | None = None,
    bound: Iterable[Bound] = (),
) -> Impact:
    """What an edit of a model touches.

    Edits of a slot touch it in the class and its descendants, and all that reads it, directly or through derived slots.
    A new slot is read by nothing yet, but changes the tables of the class, of descendants without one of that name, and
    of what feeds them. A new class touches its parent, whose queries cover it; another parent takes away the slots that
    came from the old one. Sources touch the slots they fill; another trust only those whose policy weighs it.
    An implementation is touched if it reads one of the classes, or anything that is touched itself.
    """
    if edit not in EDITS + MORE_EDITS:
        hint = suggest(edit, EDITS + MORE_EDITS)
        raise ModelError(f"unknown edit {edit!r}" + (f"; did you mean {hint!r}?" if hint else ""))
    classes, start, found = _edited(spec, edit, cls, slot, source, parent)
    refs, reached, todo = references(spec), set(start), set(start)
    while todo:
        at = todo.pop()
        for r in refs:
            if (r.cls, r.slot) == at and r.by not in found:
                found.add(r.by)
                kind, _, name = r.by.partition(":")
                if kind == "slot":
                    owner, _, own = name.partition(".")
                    new = {(c, own) for c in spec.descendants(owner)} - reached
                    reached |= new
                    todo |= new
    owners = {c for c, s in reached if s is not None}
    hit = [b for b in bound if any(c in classes or (c, s) in reached or s is None and c in owners for c, s in b.reads)]
    return Impact(tuple(sorted(classes | owners)), tuple(sorted(found)), tuple(sorted({b.path for b in hit})), tuple(sorted({b.cls for b in hit})))


def _edited(spec: Spec, edit: str, cls: str | None, slot: str | None, source: str | None, parent: str | None) -> tuple[set[str], set[tuple[str, str | None]], set[str]]:
    """The classes that an edit names, the (class, slot) whose readers it touches, and what it touches itself."""
    if edit in ("remove_source", "change_trust"):
        if source is None:
            raise ModelError(f"{edit} names a source")
        s = spec.source(source)
        fed = {s.entity, *[c for c in s.routes.values() if c]}
        filled = {(c, x.name) for c in fed for x in spec.slots(c) if x.derivation is None and not (edit == "change_trust" and x.policy in UNWEIGHED)}
        return fed, filled, {f"class:{c}" for c in fed}
    if cls is None:
        raise ModelError(f"{edit} names a class")
    if edit == "add_class":
        if spec.is_class(cls):
            raise ModelError(f"there is a class {cls!r}")
        return {cls} | ({parent} if parent else set()), {(spec.cls(parent).name, None)} if parent else set(), set()
    spec.cls(cls)
    kin = set(spec.descendants(cls))
    below = {f"class:{c}" for c in kin - {cls}}
    feeds = lambda classes: {f"source:{s.name}" for s in spec.sources if classes & {s.entity, *s.routes.values()}}
    match edit:
        case "add_slot":
            if slot is None:
                raise ModelError("add_slot names a slot")
            plain = {c for c in kin if c == cls or all(s.name != slot for s in spec.cls(c).slots)}
            return plain, set(), {f"class:{c}" for c in plain - {cls}} | feeds(plain)
        case "add_source":
            return {cls}, {(cls, s.name) for s in spec.slots(cls) if s.derivation is None}, {f"class:{cls}"}
        case "add_constraint":
            return kin, set(), below
        case "remove_class" | "rename_class":
            return kin, {(c, None) for c in kin}, below
        case "change_superclass":
            left = {s.name for s in spec.slots(parent)} if parent else set()
            own = {c: {s.name for a in spec.chain(c) if cls in {x.name for x in spec.chain(a.name)} for s in a.slots} for c in kin}
            lost = {(c, s.name) for c in kin for s in spec.slots(c) if s.name not in left | own[c]}
            named = {x for x in (spec.cls(cls).is_a, parent) if x}
            return kin | named, lost | {(x, None) for x in named}, below
    if slot is None:
        raise ModelError(f"{edit} names a slot")
    spec.slot(cls, slot)
    return kin, {(c, slot) for c in kin}, below


@dataclass(frozen=True)
class Change:
    """A part of a model that differs: its kind (``slot.added``, ``slot.range``, ``class.is_a``), name, and canonical texts."""

    kind: str
    name: str
    before: str | None
    after: str | None


def changes(old: Spec, new: Spec) -> list[Change]:
    """All differences field by field, in order of kind and name; what is only said about the model is no difference."""

    def parts(spec: Spec) -> dict[tuple[str, str], dict[str, str]]:
        look = lambda kind, x, but: {f.name: dump(getattr(x, f.name)) for f in fields(x) if f.name not in but and (kind, f.name) not in RUNTIME}
        out = {}
        for c in spec.classes:
            out["class", c.name] = look("OntologyClass", c, ("name", "slots", "constraints"))
            out |= {("slot", f"{c.name}.{s.name}"): look("Slot", s, ("name",)) for s in c.slots}
            out |= {("constraint", f"{c.name}.{k}"): {"body": dump(v)} for k, v in c.constraints.items()}
        out |= {("source", s.name): look("Source", s, ("name",)) for s in spec.sources}
        return out | {("type", t.name): look("TypeDef", t, ("name",)) for t in spec.types}

    a, b = parts(old), parts(new)
    made = [Change(f"{k}.removed", n, None, None) for k, n in a.keys() - b.keys()] + [Change(f"{k}.added", n, None, None) for k, n in b.keys() - a.keys()]
    for k, n in a.keys() & b.keys():
        made += [Change(f"{k}.{f}", n, v, b[k, n][f]) for f, v in a[k, n].items() if v != b[k, n][f]]
    return sorted(made, key=lambda c: (c.kind, c.name))


def diff(old: Spec, new: Spec) -> list[tuple[str, str]]:
    """(change, name) between two versions: classes, slots, sources and types that are added, removed or changed."""
    def parts(spec: Spec) -> dict[str, str]:
        out = {}
        for c in spec.classes:
            out[f"class:{c.name}"] = dump([c.is_a, c.mixins, c.abstract, c.identifier_pattern, c.overrides, c.unique_keys])
            out |= {f"slot:{c.name}.{s.name}": dump(s) for s in c.slots}
            out |= {f"constraint:{c.name}.{k}": dump(v) for k, v in c.constraints.items()}
        out |= {f"source:{s.name}": dump(s) for s in spec.sources}
        return out | {f"type:{t.name}": dump(t) for t in spec.types}

    a, b = parts(old), parts(new)
    made = [("removed", n) for n in a.keys() - b.keys()] + [("added", n) for n in b.keys() - a.keys()]
    return sorted(made + [("changed", n) for n in a.keys() & b.keys() if a[n] != b[n]])


def distance(a: str, b: str) -> int:
    """Edit distance, for suggestions."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def suggest(name: str, known: Iterable[str]) -> str | None:
    """The nearest known name, unless it is further than two edits or a third of the letters."""
    best = min(known, key=lambda k: (distance(name.lower(), k.lower()), k), default=None)
    return best if best is not None and distance(name.lower(), best.lower()) <= max(2, len(name) // 3) else None


def check_names(spec: Spec, wanted: Iterable[tuple[str, str | None]]) -> list[str]:
    """What is wrong with (class, slot) names that something wants to be registered for."""
    wrong = []
    classes = [c.name for c in spec.classes]
    for cls, slot in wanted:
        if cls not in classes:
            hint = suggest(cls, classes)
            wrong.append(f"no class {cls!r}" + (f"; did you mean {hint!r}?" if hint else ""))
        elif slot is not None and slot not in (names := [s.name for s in spec.slots(cls)]):
            hint = suggest(slot, names)
            wrong.append(f"class {cls!r} has no slot {slot!r}" + (f"; did you mean {hint!r}?" if hint else ""))
    return wrong


def walk_back(facts: DataFrame, bindings: DataFrame, runs: DataFrame, sources: DataFrame) -> DataFrame:
    """From each canonical id to the rows bound to it, the run that bound them, its compile hash, and the source rows."""
    bound = facts.select("canonical_id").distinct().join(bindings.select("canonical_id", "row_id", "run_id"), "canonical_id")
    return bound.join(runs.select("run_id", "compile_hash"), "run_id", "left").join(sources.select("row_id", "source", "src_key"), "row_id", "left").select(
        "canonical_id", "run_id", "compile_hash", "row_id", "source", "src_key"
    )


def retired(ids: DataFrame, redirects: DataFrame) -> DataFrame:
    """Given canonical ids, some of them old, beside the current ones."""
    return ids.join(redirects, F.col("canonical_id") == F.col("old_id"), "left").select("canonical_id", F.coalesce("current_id", "canonical_id").alias("current_id"))
