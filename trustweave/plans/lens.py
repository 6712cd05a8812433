"""Classes of a model as Python objects: ``lens.Movie.year > 1990``."""

from __future__ import annotations

from enum import Enum
from typing import Any

from trustweave.expr import RelationRef, SlotPath
from trustweave.model import ModelError, Spec


class Lens(str, Enum):
    """What a slot stands for: its resolved value, source rows, or contributions that may disagree."""

    RESOLVED = "resolved"
    PER_SOURCE = "per_source"
    DISAGREEMENT_AWARE = "disagreement_aware"
    RAW = "raw"


class ContributionPath(SlotPath):
    """A slot that has several values: it must be said which is meant before it can be compared."""

    def _compare(self, op: str, other: Any = None):
        raise TypeError(f"{self.cls}.{'.'.join(self.slots)} may have several values; use from_source(), all_(), any_() or winner()")

    def within(self, values):
        return self._compare("in")

    def between(self, lower, upper, inclusive=True):
        return self._compare("between")

    def matches(self, pattern):
        return self._compare("matches")


class ClassLens:
    def __init__(self, spec: Spec, cls: str, lens: Lens) -> None:
        self._spec, self._cls, self._lens = spec, cls, lens

    def __getattr__(self, name: str) -> SlotPath:
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]

    def __getitem__(self, name: str) -> SlotPath:
        self._spec.slot(self._cls, name)
        return (ContributionPath if self._lens is Lens.DISAGREEMENT_AWARE else SlotPath)(self._cls, (name,))

    def relation(self, slot: str) -> RelationRef:
        """The relation over a foreign key of this class."""
        self._spec.slot(self._cls, slot)
        return RelationRef(self._cls, slot)


class SpecLens:
    def __init__(self, spec: Spec, lens: Lens = Lens.RESOLVED) -> None:
        self._spec, self._lens = spec, lens

    def __getattr__(self, name: str) -> ClassLens:
        if name.startswith("_"):
            raise AttributeError(name)
        if not self._spec.is_class(name):
            raise ModelError(f"no class {name!r}")
        return ClassLens(self._spec, name, self._lens)
