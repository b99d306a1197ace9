"""Memory of Python workers, which Spark keeps for later tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa

Batches = Iterator[pa.RecordBatch]


def give_back() -> None:
    """Return freed pages to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run``, and at its end the worker holds no more than it needs while idle."""

    @wraps(run)
    def held(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            give_back()

    return held
