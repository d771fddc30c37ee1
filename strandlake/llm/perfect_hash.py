"""A minimal perfect hash over 64-bit keys, built and queried with numpy.

Each level hashes the keys that are left into twice as many slots as there are keys; keys alone in their slot stay, the
others go to the next level. A key's index is the number of set slots before its own. Keys that were not built in get
either -1 or the index of some other key, so a fingerprint has to decide.
"""

from __future__ import annotations

import numpy as np

from .hashing import mix64

GAMMA, MOST_LEVELS = 2.0, 64


class PerfectHash:
    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.bases, base = [], 0
        for bits in levels:
            ranks = np.cumsum(bits, dtype=np.int64) - bits + base
            self.bases.append(ranks)
            base += int(bits.sum())
        self.size = base

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """``keys``: distinct uint64 values."""
        levels: list[np.ndarray] = []
        left = keys
        while len(left):
            if len(levels) == MOST_LEVELS:
                raise ValueError("keys are not distinct")
            slots = max(8, int(GAMMA * len(left)))
            at = (mix64(left, len(levels) + 1) % np.uint64(slots)).astype(np.int64)
            filled = np.bincount(at, minlength=slots)
            levels.append((filled == 1).astype(np.uint8))
            left = left[filled[at] != 1]
        return cls(levels)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, dtype=np.int64)
        rest = np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            if not len(rest):
                break
            at = (mix64(keys[rest], k + 1) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at] == 1
            out[rest[hit]] = self.bases[k][at[hit]]
            rest = rest[~hit]
        return out

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], dtype="<i8")
        return sizes.tobytes() + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, "<i8", 1)[0])
        sizes = np.frombuffer(data, "<i8", n, 8)
        levels, at = [], 8 * (n + 1)
        for size in map(int, sizes):
            packed = np.frombuffer(data, np.uint8, (size + 7) // 8, at)
            levels.append(np.unpackbits(packed, count=size))
            at += len(packed)
        return cls(levels)
