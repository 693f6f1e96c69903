"""What Python workers keep between tasks.

Spark reuses its Python workers, so an operator's caches outlive its tasks and add to the
memory of the operators after it. Tasks name their operator when they start; a worker that
turns to another operator lets the earlier caches go first.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

_current = ""
_caches: list[Callable[[], None]] = []


def on_change(clear: Callable[[], None]) -> None:
    """Call ``clear`` when the worker turns to another operator."""
    _caches.append(clear)


def turn_to(operator: str) -> None:
    global _current
    if operator == _current:
        return
    if _current:
        for clear in _caches:
            clear()
        trim()
    _current = operator


def trim() -> None:
    """Collect garbage and give memory that is free in this process back to the system."""
    gc.collect()
    give_back()


def give_back() -> None:
    """Give memory that is free in this process back to the system: for the end of a task, as a worker may then wait through stages without Python."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)
