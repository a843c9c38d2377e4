"""Array kernels over the bytes of Arrow text columns: lines, words, hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

MASK = (1 << 64) - 1
CHUNK = 1 << 20
BLOCK = 1 << 17
LONG_SPAN = 256
BASE = 0x9E3779B97F4A7C15 | 1
BACK = pow(BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: bytes of words made of digits, a-z and everything beyond ASCII
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def _powers(base: int) -> np.ndarray:
    out = np.full(BLOCK + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


POWERS, BACKS = _powers(BASE), _powers(BACK)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (a finaliser of the splitmix kind)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, wide)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _TRIM = None


def release() -> None:
    """Give freed memory back to the machine: worker processes outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``texts`` of runs of whole rows with at most ``limit`` bytes each, or one longer row."""
    data, at = texts(column)
    lo = 0
    while lo < len(at) - 1:
        hi = max(int(np.searchsorted(at, at[lo] + limit, "right")) - 1, lo + 1)
        yield data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]
        lo = hi
    release()


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for spans in ascending order that don't overlap.

    Prefix sums of a polynomial modulo 2**64 are taken block by block, so memory beyond the
    text itself does not depend on its length. Such a polynomial gives some pairs of regular
    strings of 1,024 letters and more one value, whatever its base, so spans longer than
    ``LONG_SPAN`` bytes are hashed by BLAKE2.
    """
    n = len(data)
    first, last = np.zeros(len(starts), np.uint64), np.zeros(len(ends), np.uint64)
    back = np.ones(len(starts), np.uint64)
    carry, power, inverse = 0, 1, 1
    for lo in range(0, n, BLOCK):
        block = data[lo:lo + BLOCK].astype(np.uint64)
        block += np.uint64(1)
        block *= POWERS[:len(block)]
        sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(block, out=sums[1:])
        sums *= np.uint64(power)
        sums += np.uint64(carry)
        i, j = np.searchsorted(starts, (lo, lo + len(block)))
        first[i:j] = sums[starts[i:j] - lo]
        back[i:j] = BACKS[starts[i:j] - lo] * np.uint64(inverse)
        i, j = np.searchsorted(ends, (lo, lo + len(block)))
        last[i:j] = sums[ends[i:j] - lo]
        carry = int(sums[-1])
        power = power * int(POWERS[len(block)]) & MASK
        inverse = inverse * int(BACKS[len(block)]) & MASK
    first[np.searchsorted(starts, n):] = np.uint64(carry)
    last[np.searchsorted(ends, n):] = np.uint64(carry)
    found = mix((last - first) * back + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    for i in np.flatnonzero(ends - starts > LONG_SPAN):
        found[i] = int.from_bytes(blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8).digest(), "little")
    return found


def words(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes marked in ``inside``: starts, ends, and per row where its words begin
    in these (one more entry than rows). No word crosses rows."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    w = inside[data]
    opens, closes = w.copy(), w.copy()
    opens[1:] &= ~w[:-1]
    closes[:-1] &= ~w[1:]
    edges = at[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    opens[edges] = w[edges]
    closes[edges - 1] = w[edges - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, at)


def lines(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines between line feeds: starts, ends, and per row where its lines begin in these.
    An empty row has one empty line."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([at[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([at[1:], breaks]), kind="stable")
    first = np.searchsorted(breaks, at) + np.arange(len(at))
    return starts, ends, first


def stripped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans without white space at either end; a blank span becomes empty at its end."""
    dark = np.flatnonzero(~SPACE[data])
    i, j = np.searchsorted(dark, starts), np.searchsorted(dark, ends)
    full = i < j
    s, e = ends.copy(), ends.copy()
    s[full], e[full] = dark[i[full]], dark[j[full] - 1] + 1
    return s, e


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of each element, from the rows' first elements."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def lists(values: pa.Array, first: np.ndarray) -> pa.Array:
    """A list column whose rows begin at ``first`` in ``values``."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), values)
