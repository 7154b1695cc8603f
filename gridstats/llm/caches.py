"""Caches of worker processes, of which one operator's is held at a time.

Spark keeps a worker for the tasks of later stages, so what one operator
remembers would stay in memory beside what the next one does.
"""

from __future__ import annotations

from collections.abc import Callable

_emptied_by: dict[str, Callable[[], None]] = {}


def held(name: str, empty: Callable[[], None]) -> None:
    """Say how the cache ``name`` is emptied."""
    _emptied_by[name] = empty


def only(name: str | None = None) -> None:
    """Empty all caches of this process but ``name``."""
    for other, empty in _emptied_by.items():
        if other != name:
            empty()
