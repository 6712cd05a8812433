"""What the stages of a compiled workflow do: from source rows to published nodes, over the tables of a lake.

Facts of each source are normalized, their rows bound to canonical ids, contributions merged by the policies of the
model, checked, and published as nodes. Each stage writes its tables and then its key, so a later run, of another
process too, leaves out the stages whose keys are kept, and a failed run is taken up where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustweave.model import ModelError, Spec
from trustweave.operators import graph, normalize, quality, resolution, temporal, trust
from trustweave.plans.compiler import LENS_TABLE, Run, Stage, Workflow, execute
from trustweave.plans.lowering import Graph
from trustweave.plans.plugins import RunContext, defaults, load
from trustweave.sources.lake import Lake

BINDINGS = "row_id string, canonical_id string, valid_from timestamp_ntz, valid_to timestamp_ntz, run_id string, change_type string"
ERROR = quality.ERROR


@dataclass
class Build:
    """A model over a lake: readers of sources by name, plug-ins by (kind, class), and their settings.

    A resolver gets a context and ``facts`` and returns scored pairs of row ids; without one, equal identifiers are one
    entity. A check gets a context and ``resolved`` and returns offenders. A materializer gets a context, the nodes and
    the name of their table, and writes them itself. Plug-ins are functions or dotted paths.
    """

    spec: Spec
    lake: Lake
    sources: dict[str, Callable[[], DataFrame]]
    plugins: dict[tuple[str, str], Any] = field(default_factory=dict)
    config: dict[str, dict[str, Any]] = field(default_factory=dict)
    moment: str = "2000-01-01 00:00:00"
    severity: str = ERROR

    def plugin(self, kind: str, cls: str) -> Callable | None:
        found = self.plugins.get((kind, cls))
        return load(found) if isinstance(found, str) else found

    def context(self, run: str, stage: Stage) -> RunContext:
        settings = {**defaults(self.plugin(stage.kind, stage.cls)), **self.config.get(f"{stage.kind}:{stage.cls}", {})}
        return RunContext(run, self.spec, stage.cls, stage.name, settings, self.lake.spark)

    def read(self, lens: str, cls: str) -> DataFrame:
        """The table that a lens reads: facts by source, all sources together, or resolved facts."""
        table = LENS_TABLE[lens]
        if table != "per_source_facts":
            return self.lake.read(f"{table}/{cls}")
        parts = [self.lake.read(f"{table}/{cls}/{s.name}") for s in self.spec.sources if self.lake.exists(f"{table}/{cls}/{s.name}")]
        if not parts:
            raise ModelError(f"no source has facts of {cls!r}")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def key(self, cls: str) -> str:
        return next(s.name for s in self.spec.slots(cls) if s.identifier)

    # The kinds of stages

    def normalize(self, run: str, stage: Stage) -> None:
        source = self.spec.source(stage.source)
        made = normalize.normalize(self.spec, source, self.sources[source.name]())
        self.lake.write(made.facts[stage.cls], f"per_source_facts/{stage.cls}/{source.name}")
        self.lake.write(made.rejected.where(F.col("class_name") == stage.cls), f"rejected/{stage.cls}/{source.name}")

    def resolve(self, run: str, stage: Stage) -> None:
        facts = self.read("resolve", stage.cls)
        resolver = self.plugin("resolve", stage.cls)
        rows = facts.groupBy("row_id").agg(F.min("src_key").alias("src_key"))
        if resolver is None:
            fresh = rows.select("row_id", F.col("src_key").alias("canonical_id"))
        else:
            scored = resolver(self.context(run, stage), facts=facts)
            links = resolution.decide(scored.frame(), self.context(run, stage).config.get("threshold", 0.9))
            fresh = resolution.cluster(rows, links).select("row_id", F.col("cluster").alias("canonical_id"))
        name = f"bindings/{stage.cls}"
        old = self.lake.read(name) if self.lake.exists(name) else self.lake.spark.createDataFrame([], BINDINGS)
        self.lake.write(temporal.update_bindings(old, fresh, self.moment, run), name)

    def merge(self, run: str, stage: Stage) -> None:
        rows = trust.merge([self.read("dq:normalize", stage.cls)], self.lake.read(f"bindings/{stage.cls}"))
        self.lake.write(trust.with_trust(rows, self.spec), f"contributions/{stage.cls}")
        resolved = trust.resolve_class(self.lake.read(f"contributions/{stage.cls}"), self.spec, stage.cls, strict=False)
        key = self.key(stage.cls)
        kind = self.spec.schema(stage.cls)[key].dataType
        self.lake.write(resolved.withColumn(key, F.coalesce(F.col(key), F.col("canonical_id").try_cast(kind))), f"resolved_facts/{stage.cls}")

    def validate(self, run: str, stage: Stage) -> None:
        frames = {c.name: self.lake.read(f"resolved_facts/{c.name}") for c in self.spec.classes if self.lake.exists(f"resolved_facts/{c.name}")}
        contributions = {c: self.lake.read(f"contributions/{c}") for c in frames}
        found = quality.validate(Graph(self.spec, frames, contributions), stage.cls)
        check = self.plugin("validate", stage.cls)
        if check is not None:
            found = quality.union_all([found, check(self.context(run, stage), resolved=self.read("dq:merge", stage.cls))])
        self.lake.write(found, f"offenders/{stage.cls}")

    def publish(self, run: str, stage: Stage) -> None:
        quality.gate({stage.cls: (self.severity, self.lake.read(f"offenders/{stage.cls}"))})
        nodes = self.read("publish", stage.cls)
        materializer = self.plugin("publish", stage.cls)
        if materializer is not None:
            materializer(self.context(run, stage), nodes, f"nodes/{stage.cls}")
            return
        name = f"nodes/{stage.cls}"
        self.lake.write(graph.upsert_nodes(self.lake.read(name) if self.lake.exists(name) else None, nodes), name)
        self.lake.write(graph.audit_row(nodes, run, stage.key), f"audit/{stage.cls}")

    def run(self, run_id: str, workflow: Workflow) -> Run:
        """Run what is not done; the keys of finished stages and the state of the run are kept in the lake."""
        finished = set(self.lake.json_names("control/finished"))

        def handler(kind: Callable[[str, Stage], None]) -> Callable[[Stage], None]:
            def handle(stage: Stage) -> None:
                kind(run_id, stage)
                self.lake.write_json(f"control/finished/{stage.key}", {"run": run_id, "stage": stage.name})

            return handle

        handlers = {k: handler(getattr(self, k)) for k in ("normalize", "resolve", "merge", "validate", "publish")}

        def record(r: Run) -> None:
            self.lake.write_json(f"control/runs/{run_id}", {"status": r.status, "error": r.error, "done": r.done, "skipped": r.skipped, "workflow": workflow.digest})

        return execute(Run(run_id, workflow), handlers, finished, record)
