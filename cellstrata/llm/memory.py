"""Memory of reused Python workers, and Arrow batches of bounded size."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa

from cellstrata.plans.lineage import batches_of  # noqa: F401  (imported from here)


def give_back() -> None:
    """Return freed memory to the system: a worker that is used again would hold it through other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library: its allocator decides alone
        pass


def tidy(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``task``, a function of a partition's batches, that gives its memory back when it ends."""

    @functools.wraps(task)
    def run(batches: Iterator) -> Iterator:
        yield from task(batches)
        give_back()

    return run
