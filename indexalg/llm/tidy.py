"""Giving memory back: Python workers live on from task to task, beside each other."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa


def release() -> None:
    """Returns freed memory to the system, where the allocators can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass


def keep_memory() -> None:
    """Lets the allocator reuse blocks of up to 32 MB instead of mapping them anew, which numpy's temporaries of some hundred kB else cost."""
    try:
        ctypes.CDLL(None).mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
        ctypes.CDLL(None).mallopt(-1, 128 << 20)  # M_TRIM_THRESHOLD
    except (AttributeError, OSError):  # no glibc
        pass


def tidy(task: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """A task that releases memory when it ends."""

    @wraps(task)
    def own(*args, **kwargs) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(*args, **kwargs)
        finally:
            release()

    return own
