"""Models, bindings and runs kept as JSON in a lake: one file switches from an old state to a new one."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import fields
from typing import Any

from trustweave import expr as X
from trustweave import model as M
from trustweave.model import ModelError, Spec
from trustweave.plans.canonical import VERSION, digest
from trustweave.plans.compiler import KINDS, Run, check, compile_spec
from trustweave.plans.lineage import Bound, Impact, check_names, impact, suggest
from trustweave.plans.plugins import defaults, load
from trustweave.sources.lake import Conflict, Lake

_KNOWN = {c.__name__: c for m in (M, X) for c in vars(m).values() if isinstance(c, type) and hasattr(c, "__dataclass_fields__")}


def encode(v: Any) -> Any:
    """Model objects as JSON values that :func:`decode` takes back to equal ones."""
    if hasattr(v, "__dataclass_fields__"):
        return {"$type": type(v).__name__, **{f.name: encode(getattr(v, f.name)) for f in fields(v)}}
    if isinstance(v, (M.Policy, X.Agg, X.GroupBy)):
        return {"$enum": type(v).__name__, "value": v.value}
    if isinstance(v, dict):
        return {"$dict": [[k, encode(x)] for k, x in v.items()]}
    if isinstance(v, tuple):
        return {"$tuple": [encode(x) for x in v]}
    if isinstance(v, list):
        return [encode(x) for x in v]
    if v is None or isinstance(v, (bool, int, float, str)):
        return v
    return {"$text": str(v)}


def decode(v: Any) -> Any:
    if isinstance(v, list):
        return [decode(x) for x in v]
    if not isinstance(v, dict):
        return v
    if "$type" in v:
        return _KNOWN[v["$type"]](**{k: decode(x) for k, x in v.items() if k != "$type"})
    if "$enum" in v:
        return {"Policy": M.Policy, "Agg": X.Agg, "GroupBy": X.GroupBy}[v["$enum"]](v["value"])
    if "$dict" in v:
        return {k: decode(x) for k, x in v["$dict"]}
    if "$tuple" in v:
        return tuple(decode(x) for x in v["$tuple"])
    return v["$text"]


#: A change is tried anew so often where other writers were first.
TRIES = 40


def _empty() -> dict[str, Any]:
    return {"revisions": [], "drafts": {}, "implementations": {}, "settings": {}, "workflows": {}, "runs": {}, "corrections": [], "decisions": []}


class Control:
    """What an operator of the engine does besides querying: revisions of the model, of implementations and of their
    settings, compiled workflows, runs, corrections.

    All is one numbered state. A change is made to the newest state and written as the next; where another writer was
    first it is made anew to theirs, so none is lost.
    """

    def __init__(self, lake: Lake) -> None:
        self.lake = lake

    def _state(self) -> dict[str, Any]:
        return self.lake.read_state("control", _empty())[1]

    def _change(self, change: Callable[[dict[str, Any]], Any]) -> Any:
        for attempt in range(TRIES):
            number, state = self.lake.read_state("control", _empty())
            made = change(state)
            try:
                self.lake.write_state("control", state, number)
            except Conflict:
                time.sleep(0.02 * (attempt + 1))
            else:
                return made
        raise Conflict("control: others kept writing")

    # The model

    def save_draft(self, name: str, spec: Spec) -> None:
        self._change(lambda state: state["drafts"].update({name: encode(spec)}))

    def save_spec(self, spec: Spec) -> dict[str, Any]:
        """A new revision, after the whole model is checked; the same model again is no new revision."""
        check(spec)
        return self._change(lambda state: _revise(state["revisions"], "digest", digest(spec), canonical_version=VERSION, spec=encode(spec)))

    def publish_draft(self, name: str) -> dict[str, Any]:
        def publish(state: dict[str, Any]) -> dict[str, Any]:
            if name not in state["drafts"]:
                raise ModelError(f"no draft {name!r}")
            spec = decode(state["drafts"].pop(name))
            check(spec)
            return _revise(state["revisions"], "digest", digest(spec), canonical_version=VERSION, spec=encode(spec))

        return self._change(publish)

    def spec(self, revision: int | None = None) -> Spec:
        return decode(_revision(self._state()["revisions"], revision, "the model")["spec"])

    def sources(self) -> list[dict[str, Any]]:
        """The sources of the current model, in order of name."""
        return [{"name": s.name, "class": s.entity, "location": s.location, "format": s.format, "trust": s.trust} for s in sorted(self.spec().sources, key=lambda s: s.name)]

    def impact(self, edit: str, **names: str) -> Impact:
        """What an edit of the current model touches, bound implementations included."""
        bound = []
        for at, revisions in self._state()["implementations"].items():
            kind, _, cls = at.partition(":")
            bound.append(Bound(kind, cls, revisions[-1]["path"], tuple((c, s) for c, s in revisions[-1]["reads"])))
        return impact(self.spec(), edit, **names, bound=bound)

    # Implementations and their settings

    def bind(self, kind: str, cls: str, path: str, reads: list[tuple[str, str | None]] | None = None) -> dict[str, Any]:
        """Register an implementation, by dotted path, for a kind of stage of a class; names that it reads are checked.

        Another path, or other names, are a new revision. The class itself is always read.
        """
        if kind not in KINDS:
            raise ModelError(f"unknown kind of stage {kind!r}; it can be {', '.join(KINDS)}")
        wanted = [(cls, None), *(reads or [])]
        wrong = check_names(self.spec(), wanted)
        if wrong:
            raise ModelError("; ".join(wrong))
        names = sorted({(c, s) for c, s in wanted}, key=lambda n: (n[0], n[1] or ""))
        return self._change(lambda state: _revise(state["implementations"].setdefault(f"{kind}:{cls}", []), "digest", digest([path, names]), path=path, reads=[list(n) for n in names]))

    def configure(self, path: str, **settings: Any) -> dict[str, Any]:
        """Settings of a bound implementation, over those it has; other values are a new revision.

        Settings that the implementation does not declare are refused, unless it declares none at all.
        """

        def put(state: dict[str, Any]) -> dict[str, Any]:
            paths = {r["path"] for revisions in state["implementations"].values() for r in revisions}
            if path not in paths:
                hint = suggest(path, paths)
                raise ModelError(f"nothing is bound to {path!r}" + (f"; did you mean {hint!r}?" if hint else ""))
            declared = defaults(load(path))
            for name in settings:
                if declared and name not in declared:
                    hint = suggest(name, declared)
                    raise ModelError(f"{path!r} has no setting {name!r}" + (f"; did you mean {hint!r}?" if hint else ""))
            held = state["settings"].setdefault(path, [])
            values = {**(held[-1]["values"] if held else {}), **settings}
            return _revise(held, "digest", digest(values), values=values)

        return self._change(put)

    def bindings(self) -> dict[tuple[str, str], str]:
        return {tuple(k.split(":", 1)): v[-1]["path"] for k, v in self._state()["implementations"].items()}  # type: ignore[misc]

    def implementation(self, kind: str, cls: str, revision: int | None = None) -> dict[str, Any]:
        return _revision(self._state()["implementations"].get(f"{kind}:{cls}", []), revision, f"{kind}:{cls}")

    def settings(self, path: str, revision: int | None = None) -> dict[str, Any]:
        """The values that an implementation was given, as of a revision of them."""
        return _revision(self._state()["settings"].get(path, []), revision, path)["values"]

    # Workflows and runs

    def start_run(self, target: str = "all", cursors: dict[str, Any] | None = None, pins: dict[str, str] | None = None) -> Run:
        """Compile the current model and record a pending run, with the revisions that it was compiled from."""

        def start(state: dict[str, Any]) -> Run:
            spec = decode(_revision(state["revisions"], None, "the model")["spec"])
            bound = {tuple(k.split(":", 1)): v[-1]["path"] for k, v in state["implementations"].items()}
            config = {path: held[-1]["values"] for path, held in state["settings"].items()}
            workflow = compile_spec(spec, target, cursors, pins, bound, config)
            if workflow.digest not in state["workflows"]:
                stages = [{"name": s.name, "kind": s.kind, "class": s.cls, "source": s.source, "after": list(s.after), "key": s.key} for s in workflow.stages]
                state["workflows"][workflow.digest] = {"order": len(state["workflows"]), "target": target, "stages": stages}
            run = Run(uuid.uuid4().hex, workflow)
            state["runs"][run.run_id] = {
                "order": len(state["runs"]),
                "spec_revision": len(state["revisions"]),
                "implementations": {k: v[-1]["revision"] for k, v in state["implementations"].items()},
                "settings": {k: v[-1]["revision"] for k, v in state["settings"].items()},
                "cursors": {k: str(v) for k, v in (cursors or {}).items()},
                "pins": pins or {},
            }
            _put_run(state, run)
            return run

        return self._change(start)

    def record(self, run: Run) -> None:
        self._change(lambda state: _put_run(state, run))

    def run(self, run_id: str) -> dict[str, Any]:
        runs = self._state()["runs"]
        if run_id not in runs:
            raise ModelError(f"no run {run_id!r}")
        return {"run_id": run_id, **runs[run_id]}

    def runs(self, status: str | None = None, limit: int = 50) -> list[dict[str, Any]]:
        """The newest first."""
        found = [{"run_id": k, **v} for k, v in self._state()["runs"].items() if status in (None, v["status"])]
        return sorted(found, key=lambda r: -r["order"])[:limit]

    def workflows(self, limit: int = 50) -> list[dict[str, Any]]:
        """Compiled workflows, the newest first, with how many stages each has."""
        found = [{"digest": k, "target": v["target"], "n_stages": len(v["stages"]), "order": v["order"]} for k, v in self._state()["workflows"].items()]
        return sorted(found, key=lambda w: -w["order"])[:limit]

    def workflow(self, digest: str) -> dict[str, Any]:
        held = self._state()["workflows"]
        if digest not in held:
            raise ModelError(f"no workflow {digest!r}")
        return {"digest": digest, **held[digest]}

    def trace(self, run_id: str) -> dict[str, Any]:
        """What a run was made from: its workflow, model, implementations and settings as they were, and pinned parents."""
        state, run = self._state(), self.run(run_id)
        bound = {k: _revision(state["implementations"][k], n, k) for k, n in run.get("implementations", {}).items()}
        return {
            "run": run,
            "workflow": self.workflow(run["digest"]) if run["digest"] in state["workflows"] else None,
            "spec": self.spec(run["spec_revision"]) if "spec_revision" in run else None,
            "implementations": bound,
            "settings": {k: _revision(state["settings"][k], n, k)["values"] for k, n in run.get("settings", {}).items()},
            "pins": run.get("pins", {}),
        }

    # What people decide

    def correct(self, cls: str, canonical_id: str, slot: str, value: Any, submitted_at: str, reason: str = "") -> None:
        self.spec().slot(cls, slot)
        self._append("corrections", {"class_name": cls, "canonical_id": canonical_id, "slot": slot, "value": None if value is None else str(value), "submitted_at": submitted_at, "reason": reason})

    def decide(self, kind: str, cls: str, a: str, b: str, reason: str = "") -> None:
        """Force a merge or a split of two rows."""
        if kind not in ("merge", "split"):
            raise ModelError(f"unknown decision {kind!r}")
        self.spec().cls(cls)
        self._append("decisions", {"kind": kind, "class_name": cls, "a": a, "b": b, "reason": reason})

    def corrections(self, cls: str) -> list[dict[str, Any]]:
        return [c for c in self._state()["corrections"] if c["class_name"] == cls]

    def decisions(self, cls: str, kind: str | None = None) -> list[dict[str, Any]]:
        return [d for d in self._state()["decisions"] if d["class_name"] == cls and kind in (None, d["kind"])]

    def _append(self, where: str, row: dict[str, Any]) -> None:
        self._change(lambda state: state[where].append(row))


def _revise(revisions: list[dict[str, Any]], name: str, mark: str, **rest: Any) -> dict[str, Any]:
    """The last revision if it has this mark, else a new one after it."""
    if not revisions or revisions[-1][name] != mark:
        revisions.append({"revision": len(revisions) + 1, name: mark, **rest})
    return revisions[-1]


def _revision(revisions: list[dict[str, Any]], number: int | None, what: str) -> dict[str, Any]:
    if not revisions or not (number is None or 1 <= number <= len(revisions)):
        raise ModelError(f"no such revision of {what}")
    return revisions[-1 if number is None else number - 1]


def _put_run(state: dict[str, Any], run: Run) -> None:
    held = state["runs"].setdefault(run.run_id, {"order": len(state["runs"])})
    held.update({"status": run.status, "error": run.error, "digest": run.workflow.digest, "done": list(run.done), "skipped": list(run.skipped)})
