"""Python's memory within a task: Arrow batches of 10,000 rows are worked through in steps."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa

STEP = 64  # rows whose Python objects are held at once

try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _TRIM = None


def release() -> None:
    """Give freed memory back to the machine: worker processes outlive their batches."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def by_steps(fn: Callable, kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """``fn`` of every row's values, as an Arrow array; only ``STEP`` rows are Python objects."""
    parts = [pa.array([fn(*v) for v in zip(*(c.slice(at, STEP).to_pylist() for c in columns), strict=True)], kind)
             for at in range(0, len(columns[0]), STEP)]
    out = pa.concat_arrays(parts) if parts else pa.array([], kind)
    del parts
    release()
    return out
