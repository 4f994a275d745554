"""Memory of Python workers between tasks."""

from __future__ import annotations

import ctypes
import functools

import pyarrow as pa

# what a worker process keeps for later tasks, by name
CACHES: dict[str, dict] = {}


def forget(keeps=()) -> None:
    """Drop what earlier tasks kept, but the caches of these names."""
    for name, cache in CACHES.items():
        if name not in keeps:
            cache.clear()


def release() -> None:
    """Give freed memory back to the system (where the C library can)."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):   # another C library
        pass


def released(run, keeps=()):
    """``run`` of a mapInArrow with the memory of its worker looked after.

    Workers live on from stage to stage: what earlier tasks kept goes when a task
    begins (but the caches named in ``keeps``), freed memory goes back when it ends.
    """
    @functools.wraps(run)
    def wrapped(batches):
        forget(keeps)
        try:
            yield from run(batches)
        finally:
            release()
    return wrapped
