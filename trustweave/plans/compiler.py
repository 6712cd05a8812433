"""A model compiled to stages with content-addressed keys, and their execution with those that are done left out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from trustweave import expr as X
from trustweave.model import DirectRef, DiscriminatedRef, ModelError, OntologyClass, PolymorphicRef, Spec
from trustweave.plans.canonical import digest, plain

KINDS = ("normalize", "resolve", "merge", "validate", "publish")
#: What each kind of stage reads: facts by source, or resolved contributions.
LENS_TABLE = {"resolve": "per_source_facts", "dq:normalize": "per_source_facts", "publish": "resolved_facts", "dq:merge": "resolved_facts", "dq:publish": "resolved_facts", "merge": "resolved_facts"}


@dataclass(frozen=True)
class Stage:
    name: str
    kind: str
    cls: str
    source: str | None
    after: tuple[str, ...]
    key: str


@dataclass(frozen=True)
class Workflow:
    stages: tuple[Stage, ...]
    #: Hash of everything that was compiled.
    digest: str


def topological(graph: dict[str, set[str]]) -> list[str]:
    """An order in which everything follows what it depends on; alphabetical where that leaves a choice."""
    left = {k: set(v) & set(graph) for k, v in graph.items()}
    order = []
    while left:
        ready = sorted(k for k, v in left.items() if not v)
        if not ready:
            raise ValueError("cycle among " + ", ".join(sorted(left)))
        order.append(ready[0])
        del left[ready[0]]
        for v in left.values():
            v.discard(ready[0])
    return order


def class_dependencies(spec: Spec) -> dict[str, set[str]]:
    """Classes by those that their own foreign keys, supers and mixins name; a class's keys to itself don't count."""
    out: dict[str, set[str]] = {}
    for c in spec.classes:
        found = {c.is_a} if c.is_a else set()
        found |= set(c.mixins)
        for s in spec.slots(c.name):
            match s.reference:
                case DirectRef():
                    found.add(s.reference.target)
                case DiscriminatedRef():
                    found |= set(s.reference.targets)
                case PolymorphicRef():
                    found |= set(s.reference.candidates)
            if s.derivation is None and spec.is_class(s.range):
                found.add(s.range)
        out[c.name] = found - {c.name}
    return out


def check(spec: Spec) -> None:
    """Everything that can be refused before any data is read."""
    for c in spec.classes:
        for name in c.identifier_pattern or ():
            spec.slot(c.name, name)
        for s in spec.slots(c.name):
            spec.base_type(s)
            if s.derivation is None:
                continue
            for n in X.walk(s.derivation):
                if isinstance(n, X.RecursiveTraversal):
                    raise ModelError(f"{c.name}.{s.name}: a derivation can't be recursive")
                if isinstance(n, X.RelationAggregate) and n.pivot == () and n.group_by == X.GroupBy.SOURCE:
                    raise ModelError(f"{c.name}.{s.name}: grouped by source it has no single value")
                if isinstance(n, X.SlotPath):
                    _check_path(spec, n)
                if isinstance(n, X.RelationRef):
                    spec.slot(n.from_class, n.slot)
        topological({s.name: _derived_from(spec, c, s.derivation) for s in spec.slots(c.name) if s.derivation is not None})


def _derived_from(spec: Spec, c: OntologyClass, derivation: X.Node) -> set[str]:
    """Derived slots of the class that a derivation reads; one that reads itself is a cycle."""
    derived = {s.name for s in spec.slots(c.name) if s.derivation is not None}
    read = {n.slots[0] for n in X.walk(derivation) if isinstance(n, X.SlotPath) and n.slots and n.cls == c.name}
    return read & derived


def _check_path(spec: Spec, n: X.SlotPath) -> None:
    at = n.cls
    for i, name in enumerate(n.slots):
        s = spec.slot(at, name)
        if i + 1 < len(n.slots):
            if not spec.is_class(s.range) and s.reference is None:
                raise ModelError(f"{n.cls}.{'.'.join(n.slots)}: {name!r} leads nowhere")
            at = s.reference.candidates[0] if isinstance(s.reference, PolymorphicRef) else s.reference.targets[0] if isinstance(s.reference, DiscriminatedRef) else s.range


def stage_key(parts: Any) -> str:
    return digest(parts)


def compile_spec(
    spec: Spec,
    target: str = "all",
    cursors: dict[str, Any] | None = None,
    pins: dict[str, str] | None = None,
    implementations: dict[tuple[str, str], str] | None = None,
    config: dict[str, dict[str, Any]] | None = None,
) -> Workflow:
    """Stages in an order in which they can run.

    ``target`` is all, class:<name> or stage:<kind>:<class>, with all that it needs. A key covers the class, its source
    and its cursor, the implementation and its settings, pinned parents, and the keys of all stages before: an equal key
    means equal results.
    """
    check(spec)
    cursors, pins, implementations, config = cursors or {}, pins or {}, implementations or {}, config or {}
    deps = class_dependencies(spec)
    made: dict[str, Stage] = {}

    def add(kind: str, cls: str, source: str | None, after: list[str], extra: Any) -> str:
        name = ":".join([kind, cls] + ([source] if source else []))
        chain = [plain(c) for c in spec.chain(cls)]
        bound = implementations.get((kind, cls))
        parts = {"kind": kind, "class": chain, "after": [made[a].key for a in sorted(after)], "implementation": bound, "config": config.get(bound or "", {}), "extra": extra}
        made[name] = Stage(name, kind, cls, source, tuple(sorted(after)), stage_key(parts))
        return name

    for cls in topological(deps):
        c = spec.cls(cls)
        if c.abstract:
            continue
        feeds = [s for s in spec.sources if s.entity == cls or cls in s.routes.values()]
        parents = {p: pins[p] if p in pins else made[f"merge:{p}"].key for p in sorted(deps[cls]) if p in pins or f"merge:{p}" in made}
        normal = [add("normalize", cls, s.name, [], {"source": plain(s), "cursor": str(cursors.get(s.name))}) for s in feeds]
        resolve = add("resolve", cls, None, normal, {"parents": parents})
        merge = add("merge", cls, None, [*normal, resolve], None)
        validate = add("validate", cls, None, [merge], None)
        add("publish", cls, None, [merge, validate], None)
    wanted = _closure(made, target)
    stages = tuple(s for n, s in made.items() if n in wanted)
    return Workflow(stages, digest([s.key for s in stages]))


def _closure(made: dict[str, Stage], target: str) -> set[str]:
    if target == "all":
        return set(made)
    kind, _, rest = target.partition(":")
    if kind == "class":
        todo = [n for n, s in made.items() if s.cls == rest]
    elif kind == "stage":
        wanted, _, cls = rest.partition(":")
        todo = [n for n, s in made.items() if s.cls == cls and s.kind == wanted]
    else:
        raise ModelError(f"unknown target {target!r}")
    if not todo:
        raise ModelError(f"nothing to run for {target!r}")
    found: set[str] = set()
    while todo:
        n = todo.pop()
        if n not in found:
            found.add(n)
            todo.extend(made[n].after)
    return found


@dataclass
class Run:
    """One execution: pending, running, then succeeded or failed."""

    run_id: str
    workflow: Workflow
    status: str = "pending"
    error: str | None = None
    done: list[str] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)


def execute(run: Run, handlers: dict[str, Callable[[Stage], None]], finished: set[str], record: Callable[[Run], None] = lambda r: None) -> Run:
    """Run the stages in order; those whose key is among ``finished`` are left out. A failure is recorded and raised."""
    run.status = "running"
    record(run)
    try:
        for stage in run.workflow.stages:
            if stage.key in finished:
                run.skipped.append(stage.name)
                continue
            if stage.kind not in handlers:
                raise ModelError(f"nothing is bound to {stage.kind} stages")
            handlers[stage.kind](stage)
            finished.add(stage.key)
            run.done.append(stage.name)
    except Exception as e:
        run.status, run.error = "failed", f"{type(e).__name__}: {e}"
        record(run)
        raise
    run.status = "succeeded"
    record(run)
    return run
