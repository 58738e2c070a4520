"""Minimal perfect hashing of 64-bit keys, level by level, on numpy arrays.

A level has a bit for each of its places; keys that are alone at their place set its bit,
the others go on to the next level. A key's index is the number of set bits before its own,
over all levels, so n keys get the indexes 0 to n - 1. A key that was not built in may get
an index too, so the keys are kept in the order of their indexes and every answer is
verified.
"""

from __future__ import annotations

import numpy as np

#: Places of a level for each key that reaches it.
GAMMA = 1.6


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing of ``x``, one to one."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Indexes of the distinct int64 ``keys``; ``keys`` come to stand in the order of their indexes."""

    def __init__(self, keys: np.ndarray):
        self.bits: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        rest, placed, seen = np.asarray(keys, dtype=np.int64), [], 0
        while len(rest):
            size = max(64, int(len(rest) * GAMMA) + 63 & ~63)
            at = self._places(rest, len(self.bits), size)
            alone = np.bincount(at, minlength=size) == 1
            own = alone[at]
            words = np.packbits(alone, bitorder="little").view(np.uint64)
            counts = np.bitwise_count(words).astype(np.int64)
            self.bits.append(words)
            self.before.append(seen + np.cumsum(counts) - counts)
            order = np.argsort(at[own], kind="stable")
            placed.append(rest[own][order])
            seen += int(own.sum())
            rest = rest[~own]
        self.keys = np.concatenate(placed) if placed else np.zeros(0, np.int64)

    @staticmethod
    def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        h = mix(keys.view(np.uint64) ^ mix(np.full(1, level, dtype=np.uint64)))
        return ((h >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key, and -1 for a key that was not built in."""
        keys = np.ascontiguousarray(keys, dtype=np.int64)
        out = np.full(len(keys), -1, dtype=np.int64)
        todo = np.arange(len(keys))
        for level, (bits, before) in enumerate(zip(self.bits, self.before, strict=True)):
            at = self._places(keys[todo], level, 64 * len(bits))
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (bits[word] >> bit & np.uint64(1)).astype(bool)
            low = bits[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[todo[hit]] = before[word[hit]] + np.bitwise_count(low).astype(np.int64)
            todo = todo[~hit]
            if not len(todo):
                break
        if len(self.keys):
            out[self.keys[np.maximum(out, 0)] != keys] = -1
        return out
