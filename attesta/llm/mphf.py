"""Minimal perfect hashes over 64-bit keys, with fingerprints and counts in arrays."""

from __future__ import annotations

import struct

import numpy as np

from attesta.llm.kernels import mix

GAMMA, LEVELS = 2, 40
HEAD = struct.Struct("<II")


def _slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)


class Index:
    """Slots 0 to n - 1 for n distinct keys, and for each slot a 32-bit fingerprint and a
    count that stops at 255.

    Level by level, the keys without a slot are hashed into twice as many bits; those alone
    on a bit have it as theirs. A key's slot is the number of set bits before its own.
    """

    def __init__(self, sizes: list[int], bits: np.ndarray, prints: np.ndarray, counts: np.ndarray):
        self.sizes, self.bits, self.prints, self.counts = sizes, bits, prints, counts
        self.before = np.zeros(len(bits) + 1, np.int64)
        np.cumsum(bits, out=self.before[1:])

    @staticmethod
    def fingerprint(keys: np.ndarray) -> np.ndarray:
        return (mix(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(32)).astype(np.uint32)

    @classmethod
    def build(cls, keys: np.ndarray, counts: np.ndarray) -> Index:
        sizes, planes, left, level = [], [], keys, 0
        while len(left):
            if level == LEVELS:
                raise ValueError("keys are not distinct")
            size = GAMMA * len(left)
            at = _slots(left, level, size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            planes.append(alone)
            left = left[~alone[at]]
            level += 1
        bits = np.concatenate(planes) if planes else np.zeros(0, bool)
        out = cls(sizes, bits, np.zeros(len(keys), np.uint32), np.zeros(len(keys), np.uint8))
        slots = out.slots(keys)
        out.prints[slots] = cls.fingerprint(keys)
        out.counts[slots] = np.minimum(counts, 255)
        return out

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slots of keys of the index; anything, or -1, for other keys."""
        out = np.full(len(keys), -1, np.int64)
        todo, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = base + _slots(keys[todo], level, size)
            own = self.bits[at]
            out[todo[own]] = self.before[at[own]]
            todo = todo[~own]
            base += size
            if not len(todo):
                break
        return out

    def count(self, keys: np.ndarray) -> np.ndarray:
        """Counts up to 255 of keys; 0 for keys whose fingerprint is not in their slot."""
        slots = self.slots(keys)
        found = slots >= 0
        slots[~found] = 0
        if not len(self.counts):
            return np.zeros(len(keys), np.uint8)
        found &= self.prints[slots] == self.fingerprint(keys)
        return np.where(found, self.counts[slots], 0)

    def dump(self) -> bytes:
        return b"".join([HEAD.pack(len(self.sizes), len(self.prints)), np.array(self.sizes, "<u4").tobytes(),
                         np.packbits(self.bits).tobytes(), self.prints.astype("<u4").tobytes(), self.counts.tobytes()])

    @classmethod
    def load(cls, data: bytes) -> Index:
        levels, n = HEAD.unpack_from(data)
        sizes = np.frombuffer(data, "<u4", levels, HEAD.size)
        total = int(sizes.sum())
        at = HEAD.size + 4 * levels
        bits = np.unpackbits(np.frombuffer(data, np.uint8, -(-total // 8), at))[:total].astype(bool)
        at += -(-total // 8)
        return cls([int(x) for x in sizes], bits, np.frombuffer(data, "<u4", n, at),
                   np.frombuffer(data, np.uint8, n, at + 4 * n))
