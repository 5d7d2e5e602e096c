"""Operators by name, so that a query can name what it applies.

Kinds are plain strings; the library registers its own operators when their modules are
imported (``load``), users add theirs with ``register``.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module
from typing import Any

# The kinds of extension points.
KINDS = (
    "normalisation", "statistic", "adjustment", "combinator", "pair_statistic", "genotype_filter", "site_format", "alignment_filter",
    "row_processor", "position_aggregate", "weight", "mode",
)
_MODULES = (
    "readloom.operators.stats", "readloom.operators.expression", "readloom.operators.variants", "readloom.operators.calls",
    "readloom.operators.align", "readloom.operators.entries", "readloom.operators.methylation", "readloom.functions.sequence",
)
_known: dict[str, dict[str, Any]] = {kind: {} for kind in KINDS}


def register(kind: str, name: str, value: Any = None) -> Any:
    """Register ``value`` under a name, or, without it, the function that is decorated. A name in use is an error."""
    if kind not in _known:
        raise ValueError(f"no kind {kind!r}; there are {', '.join(KINDS)}")

    def put(v: Any) -> Any:
        if _known[kind].get(name, v) is not v:
            raise ValueError(f"{kind} {name!r} is registered already")
        _known[kind][name] = v
        return v

    return put if value is None else put(value)


def load() -> None:
    for module in _MODULES:
        import_module(module)


def named(kind: str, name: str) -> Callable:
    load()
    try:
        return _known[kind][name]
    except KeyError:
        raise ValueError(f"no {kind} {name!r}; there are {', '.join(sorted(_known.get(kind, ())))}") from None


def names(kind: str) -> list[str]:
    load()
    return sorted(_known[kind])


def unregister(kind: str, name: str) -> None:
    _known[kind].pop(name, None)
