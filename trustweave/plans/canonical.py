"""A model or expression as canonical JSON, and hashes of it."""

from __future__ import annotations

import hashlib
import json
from dataclasses import MISSING, fields, is_dataclass
from enum import Enum
from typing import Any

VERSION = 1
#: Fields, by type, that say where rows come from, or something about the model, and not what it means.
RUNTIME = frozenset(
    [("Source", "location"), *[(t, "description") for t in ("OntologyClass", "Slot", "TypeDef")], *[("Spec", f) for f in ("author", "label", "created_at")]]
)


def plain(value: Any, _open: tuple[int, ...] = ()) -> Any:
    """Dictionaries, lists, texts and numbers; fields at their default are left out, and objects name their type."""
    if is_dataclass(value) and not isinstance(value, type):
        if id(value) in _open:
            return {"$ref": f"{type(value).__name__}:{getattr(value, 'name', '?')}"}
        out: dict[str, Any] = {"$type": type(value).__name__}
        for f in fields(value):
            v = getattr(value, f.name)
            default = f.default if f.default is not MISSING else f.default_factory() if f.default_factory is not MISSING else MISSING
            if (type(value).__name__, f.name) in RUNTIME or (default is not MISSING and type(v) is type(default) and not is_dataclass(v) and v == default):
                continue
            out[f.name] = plain(v, (*_open, id(value)))
        return out
    if isinstance(value, Enum):
        return value.value
    if isinstance(value, dict):
        return {str(k): plain(v, _open) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v, _open) for v in value]
    if isinstance(value, (set, frozenset)):
        return sorted((plain(v, _open) for v in value), key=repr)
    if value is None or isinstance(value, (bool, int, str)):
        return value
    if isinstance(value, float):
        return int(value) if value.is_integer() else float(repr(value))
    return str(value)


def dump(value: Any) -> str:
    """The same text for the same meaning: sorted keys, no white space."""
    return json.dumps({"v": VERSION, "d": plain(value)}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest(value: Any) -> str:
    return hashlib.sha256(dump(value).encode()).hexdigest()
