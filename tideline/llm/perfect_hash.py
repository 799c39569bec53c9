"""A minimal perfect hash over 64-bit keys, as a cascade of bit arrays.

On each level the keys that are left are hashed into an array of twice their
number of bits; a key that has its place to itself is settled there, the others
go on to the next level. A key's number is the count of set bits before its
place, so n keys get the numbers 0 to n - 1, in about four bits a key. A key
that is not among the n gets some number or none; the caller tells by a fingerprint.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tideline.llm.common import mixed

SPREAD = 2


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mixed(keys ^ mixed(np.uint64([level + 1]))[0]) % np.uint64(size)).astype(np.int64)


@dataclass
class PerfectHash:
    levels: list[np.ndarray]  # bool per place

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        """From distinct keys."""
        levels, left = [], np.asarray(keys, np.uint64)
        while len(left):
            size = max(8, SPREAD * len(left))
            place = _place(left, len(levels), size)
            alone = np.bincount(place, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[place]]
        return cls(levels)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 where no level settles it."""
        out = np.full(len(keys), -1, np.int64)
        left, base = np.arange(len(keys)), 0
        for level, bits in enumerate(self.levels):
            place = _place(keys[left], level, len(bits))
            settled = bits[place]
            rank = np.cumsum(bits) - bits
            out[left[settled]] = base + rank[place[settled]]
            left, base = left[~settled], base + int(bits.sum())
        return out

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], "<u4").tobytes()
        return sizes + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, "<u4", 1)[0])
        sizes = np.frombuffer(data, "<u4", n, 4).tolist()
        at, levels = 4 + 4 * n, []
        for size in sizes:
            used = (size + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, used, at), count=size).astype(bool))
            at += used
        return cls(levels)
