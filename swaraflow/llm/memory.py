"""What a Python worker gives back between tasks.

Workers are reused by the stages that follow.  Blocks that a stage has freed stay
with its allocators, so without this a chain of stages adds up their peaks.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

Batches = Iterator[pa.RecordBatch]


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def trimmed(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` for ``mapInArrow``; at the end of a task freed memory goes back to the system."""

    def task(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            release()

    return task
