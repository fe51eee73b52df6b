"""Memory of Python workers, which live on after a task and are used for the next."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa


def release() -> None:
    """Give memory that is free back to the system; allocators would keep it for later."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def releasing(scan: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``scan``, with what it held given back when it ends."""

    @functools.wraps(scan)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from scan(batches)
        finally:
            release()

    return run
