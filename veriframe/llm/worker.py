"""What a Python worker keeps between tasks."""

from __future__ import annotations

from collections.abc import Callable, Hashable

_kept: dict = {}


def resident(key: Hashable, build: Callable[[], object]) -> object:
    """The object of a key, built when first asked for. A worker keeps one: models and caches of different
    operators, which Spark runs in the same workers one after another, don't add up."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = build()
    return _kept[key]
