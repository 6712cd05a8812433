"""What users may plug in: functions from DataFrames to DataFrames, named by dotted path."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from importlib import import_module
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession

from trustweave import expr as X
from trustweave.model import ModelError, Spec
from trustweave.operators.resolution import Scored
from trustweave.plans.lineage import expression_refs
from trustweave.plans.lowering import Graph


@dataclass(frozen=True)
class DataContext:
    """What a plug-in reads: one class or several, the rows for which ``where`` is true, and the slots of ``project``."""

    primary: str | tuple[str, ...]
    where: X.Node | None = None
    project: tuple[str, ...] = ()
    include: dict[str, X.Node] = field(default_factory=dict, hash=False)


@dataclass(frozen=True)
class RunContext:
    """What a plug-in is told about its run."""

    run_id: str
    spec: Spec
    cls: str
    stage: str
    config: dict[str, Any] = field(default_factory=dict, hash=False)
    spark: SparkSession | None = field(default=None, compare=False)


class Resolver(Protocol):
    def __call__(self, context: RunContext, **inputs: DataFrame) -> Scored: ...


class Check(Protocol):
    def __call__(self, context: RunContext, **inputs: DataFrame) -> DataFrame: ...


class Materializer(Protocol):
    def __call__(self, context: RunContext, df: DataFrame, target: str) -> str: ...


class Translator(Protocol):
    def __call__(self, context: RunContext, expression: X.Node) -> Any: ...


def load(path: str) -> Callable[..., Any]:
    """A function by its dotted path, ``package.module:name``."""
    module, _, name = path.partition(":")
    if not name:
        raise ModelError(f"{path!r} has no :name")
    found = getattr(import_module(module), name, None)
    if not callable(found):
        raise ModelError(f"{path!r} isn't callable")
    return found


def settings(**values: Any) -> Callable[[Callable[..., Any]], Callable[..., Any]]:
    """Declare a plug-in's settings with their defaults; each can also be read as an attribute of the plug-in."""

    def put(fn: Callable[..., Any]) -> Callable[..., Any]:
        taken = [k for k in values if hasattr(fn, k)]
        if taken:
            raise ModelError(f"a function has {taken[0]!r} already")
        fn.settings = dict(values)  # type: ignore[attr-defined]
        for k, v in values.items():
            setattr(fn, k, v)
        return fn

    return put


def defaults(plugin: Callable[..., Any] | None) -> dict[str, Any]:
    """The settings that a plug-in declares; none for one that declares nothing."""
    return dict(getattr(plugin, "settings", {}))


def reads(spec: Spec, context: DataContext) -> set[tuple[str, str | None]]:
    """The (class, slot) names that a context reads; the class alone stands for its whole rows."""
    found: set[tuple[str, str | None]] = set()
    for cls in (context.primary,) if isinstance(context.primary, str) else context.primary:
        found |= {(cls, name) for name in context.project} | {(cls, None)}
    for n in [*([context.where] if context.where is not None else []), *context.include.values()]:
        found |= {(r.cls, r.slot) for r in expression_refs(spec, n, "")}
    return found


def fulfil(graph: Graph, context: DataContext, config: dict[str, Any] | None = None) -> dict[str, DataFrame]:
    """A DataFrame for each class that a context names; errors are raised, never turned into other data."""
    classes = (context.primary,) if isinstance(context.primary, str) else context.primary
    made = {}
    for cls in classes:
        df = graph.frame(cls)
        if context.where is not None:
            df = graph.where(cls, X.bind_config(context.where, config or {}), df)
        if context.include:
            names = list(context.project) or df.columns
            df = graph.derive(cls, context.include, df).select(*names, *context.include)
        elif context.project:
            df = df.select(*context.project)
        made[cls] = df
    return made
