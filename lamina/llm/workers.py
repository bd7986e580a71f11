"""What Python workers keep between tasks, and what they give back.

Spark's workers outlive a task and take turns, so what one keeps is held once per
worker, also while later stages run in the JVM. Everything kept is registered here under
the name of its owner: a task of another operator drops it before it starts, and each
task returns its freed memory to the system when it ends.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa

_KEPT: dict[str, Any] = {}


def kept(owner: str, make: Callable[[], Any]) -> Any:
    """The one thing that `owner` keeps in this worker; made at the first call."""
    if owner not in _KEPT:
        _KEPT.clear()
        _KEPT[owner] = make()
    return _KEPT[owner]


def give_back() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def _cleaned(run: Callable[[Iterator], Iterator], owner: str, batches: Iterator) -> Iterator:
    for name in [x for x in _KEPT if x != owner]:
        del _KEPT[name]
    try:
        yield from run(batches)
    finally:
        if owner == "":
            _KEPT.clear()
        give_back()


def task(run: Callable[[Iterator], Iterator], owner: str = "") -> Callable[[Iterator], Iterator]:
    """`run` over the batches of a task, in a worker that holds nothing of other operators and nothing freed afterwards."""

    def inside(batches: Iterator) -> Iterator:
        # this function travels by value, with copies of the globals that it names; one of the module travels by name and sees the worker's own
        yield from _cleaned(run, owner, batches)

    return inside
