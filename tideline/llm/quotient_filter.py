"""A counting quotient filter over 64-bit fingerprints.

A fingerprint is split into a quotient (its upper bits) and a remainder. The
remainders of one quotient form a run of sorted slots; one bit per quotient says
whether it has a run, one bit per slot whether the run ends there. A count above
one follows its remainder as digits in base ``2**r``, marked by a third bit.
Quotient and remainder together are the fingerprint, so filters of different
sizes merge without loss: their sorted contents are merged and laid out anew.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

HEAD = "<BBQ"


@dataclass
class CountingQuotientFilter:
    quotient_bits: int
    occupied: np.ndarray  # bool per quotient
    run_ends: np.ndarray  # bool per slot
    digits: np.ndarray  # bool per slot: part of a count
    slots: np.ndarray  # uint64 per slot, `remainder_bits` wide

    @property
    def remainder_bits(self) -> int:
        return 64 - self.quotient_bits

    @classmethod
    def of(cls, prints: np.ndarray, counts: np.ndarray | None = None) -> CountingQuotientFilter:
        """From fingerprints in any order, repeated or not."""
        prints = np.asarray(prints, np.uint64)
        counts = np.ones(len(prints), np.uint64) if counts is None else np.asarray(counts, np.uint64)
        # A stable sort merges inputs that are sorted already.
        order = np.argsort(prints, kind="stable")
        prints, counts = prints[order], counts[order]
        if len(prints):
            first = np.flatnonzero(np.r_[True, prints[1:] != prints[:-1]])
            prints, counts = prints[first], np.add.reduceat(counts, first)
        bits = min(24, max(4, int(len(prints)).bit_length()))
        r = np.uint64(64 - bits)
        mask = (np.uint64(1) << r) - np.uint64(1)
        quotients = (prints >> r).astype(np.int64)

        extra = np.zeros(len(prints), np.int64)
        rest = counts - np.uint64(1) if len(prints) else counts
        while rest.any():
            extra += rest > 0
            rest = rest >> r
        start = np.cumsum(extra + 1) - extra - 1
        n_slots = int((extra + 1).sum())
        slots, digits = np.zeros(n_slots, np.uint64), np.zeros(n_slots, bool)
        slots[start] = prints & mask
        rest = counts - np.uint64(1) if len(prints) else counts
        for j in range(int(extra.max(initial=0))):
            has = extra > j
            slots[start[has] + 1 + j] = rest[has] & mask
            digits[start[has] + 1 + j] = True
            rest = rest >> r
        occupied = np.zeros(1 << bits, bool)
        occupied[quotients] = True
        run_ends = np.zeros(n_slots, bool)
        if len(prints):
            last = np.flatnonzero(np.r_[quotients[1:] != quotients[:-1], True])
            run_ends[start[last] + extra[last]] = True
        return cls(bits, occupied, run_ends, digits, slots)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct fingerprints in ascending order, and their counts."""
        r = np.uint64(self.remainder_bits)
        run = np.cumsum(self.run_ends) - self.run_ends
        quotient = np.flatnonzero(self.occupied).astype(np.uint64)[run] if len(run) else np.empty(0, np.uint64)
        heads = np.flatnonzero(~self.digits)
        prints = (quotient[heads] << r) | self.slots[heads]
        counts = np.ones(len(heads), np.uint64)
        width = np.diff(np.r_[heads, len(self.slots)]) - 1
        for j in range(int(width.max(initial=0))):
            has = width > j
            counts[has] += self.slots[heads[has] + 1 + j] << (r * np.uint64(j))
        return prints, counts

    def merged(self, *others: CountingQuotientFilter) -> CountingQuotientFilter:
        parts = [f.items() for f in (self, *others)]
        return CountingQuotientFilter.of(np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts]))

    def to_bytes(self) -> bytes:
        wide = (self.remainder_bits + 7) // 8
        packed = self.slots.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide]
        bits = [np.packbits(x).tobytes() for x in (self.occupied, self.run_ends, self.digits)]
        return struct.pack(HEAD, self.quotient_bits, wide, len(self.slots)) + b"".join(bits) + packed.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        bits, wide, n = struct.unpack_from(HEAD, data)
        at, out = struct.calcsize(HEAD), []
        for size in (1 << bits, n, n):
            used = (size + 7) // 8
            out.append(np.unpackbits(np.frombuffer(data, np.uint8, used, at), count=size).astype(bool))
            at += used
        slots = np.zeros((n, 8), np.uint8)
        slots[:, :wide] = np.frombuffer(data, np.uint8, n * wide, at).reshape(n, wide)
        return cls(bits, *out, slots.reshape(-1).view("<u8").astype(np.uint64))
