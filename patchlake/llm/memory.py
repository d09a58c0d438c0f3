"""Memory of reused Python workers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def give_back() -> None:
    """Free pages of Arrow's pool and of the allocator go back to the system, where it has a call for that."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(task: Task) -> Task:
    """A task function that gives memory back after each batch that it has read, and at its end.

    A worker lives on for the tasks of later stages, and one that waits would keep what its largest task took.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                give_back()

        try:
            yield from task(each())
        finally:
            give_back()

    return run
