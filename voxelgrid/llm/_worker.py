"""What a Python worker keeps between tasks: the tables of one operator at a time.

Workers outlive their tasks and serve one operator after the other; without this, each
would in the end hold the models and caches of all of them.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable

import pyarrow as pa

_kept: list = []


def kept(key: Hashable, make: Callable[[], object]):
    """The object under this key, made anew where another one was kept last."""
    if not _kept or _kept[0] != key:
        _kept.clear()
        release()
        _kept[:] = [key, make()]
    return _kept[1]


def forget() -> None:
    """Drops what an operator before has kept; for operators that keep nothing themselves."""
    if _kept:
        _kept.clear()
        release()


def release() -> None:
    """Gives unused memory back to the system, where its allocators can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
