"""Canonical, length-limited Huffman codes over integer ids, in whole arrays.

Code lengths come from package-merge; codes are canonical, so the lengths alone
describe them. The bit stream is big-endian, and checkpoints hold the bit at which
every ``step``-th id starts: decoding looks up all these places at once, one id of
each per turn, in a table over the next ``limit`` bits.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np

#: A window of 32 bits holds a code at any bit of a byte.
LONGEST_LIMIT = 25
CHUNK = 1 << 18


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Bits per id (0: does not occur) of the best code without longer ones than ``limit``."""
    if len(counts) > 1 << 27:
        raise ValueError("ids must be below 2^27")
    if limit > LONGEST_LIMIT:
        raise ValueError(f"codes may have {LONGEST_LIMIT} bits at most")
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit into {limit} bits")
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    packages, levels = np.empty(0, np.int64), []
    for _ in range(limit):
        items = np.concatenate([leaves, packages])
        at = np.argsort(items, kind="stable")
        levels.append(np.cumsum(at < len(leaves)))
        items = items[at]
        packages = items[: len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
    bits = np.zeros(len(order), np.uint8)
    taken = 2 * len(order) - 2
    for chosen in reversed(levels):
        if taken == 0:
            break
        singles = int(chosen[taken - 1])
        bits[:singles] += 1
        taken = 2 * (taken - singles)
    lengths[order] = bits
    return lengths


class Code:
    """Codes and decoding table that belong to the lengths of all ids."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = np.asarray(lengths, np.uint8)
        self.limit = max(1, int(self.lengths.max(initial=0)))
        #: Ids in the order of their codes.
        used = np.flatnonzero(self.lengths)
        self.order = used[np.argsort(self.lengths[used], kind="stable")]

    @cached_property
    def codes(self) -> np.ndarray:
        bits = self.lengths[self.order].astype(np.int64)
        # In the unit of the longest code every code starts where the one before it ends.
        width = np.left_shift(1, self.limit - bits)
        codes = np.zeros(len(self.lengths), np.uint64)
        codes[self.order] = (np.cumsum(width) - width) >> (self.limit - bits)
        return codes

    @cached_property
    def table(self) -> np.ndarray:
        """For each value of the next ``limit`` bits the id, times 32, plus the bits it takes."""
        bits = self.lengths[self.order].astype(np.int64)
        entries = np.repeat((self.order << 5 | bits).astype(np.uint32), np.left_shift(1, self.limit - bits))
        return np.concatenate([entries, np.zeros((1 << self.limit) - len(entries), np.uint32)])

    def _packed(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits of some ids from a byte's start, and the bit at which each one starts."""
        bits = self.lengths[ids].astype(np.int64)
        end = np.cumsum(bits)
        start = end - bits
        word = start >> 5
        placed = self.codes[ids] << (64 - (start & 31) - bits).astype(np.uint64)
        out = np.zeros((int(end[-1]) >> 5) + 2, np.uint64)
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        out[word[first]] = np.add.reduceat(placed >> np.uint64(32), first)
        # At most one code runs on into the next word.
        rest = placed & np.uint64(0xFFFFFFFF)
        over = np.flatnonzero(rest)
        out[word[over] + 1] |= rest[over]
        return out.astype(">u4").tobytes()[: (int(end[-1]) + 7) >> 3], start

    def encode(self, ids: np.ndarray, step: int) -> tuple[bytes, np.ndarray]:
        """Bit stream and checkpoints; chunks of ids start at whole bytes."""
        chunk = max(1, CHUNK // step) * step
        parts, marks, at = [], [], 0
        for i in range(0, len(ids), chunk):
            data, start = self._packed(ids[i : i + chunk])
            parts.append(data)
            marks.append(start[::step] + 8 * at)
            at += len(data)
        return b"".join(parts), np.concatenate(marks) if marks else np.empty(0, np.int64)

    def decode(self, data: bytes, marks: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The ids of a bit stream: ``counts[i]`` of them from each checkpoint on."""
        if not len(marks):
            return np.empty(0, np.uint32)
        longest_first = np.argsort(-counts, kind="stable")
        place = np.array(marks, np.int64)[longest_first]
        turns = int(counts.max())
        # How many places still have an id in each turn.
        active = np.searchsorted(-counts[longest_first], -np.arange(turns), side="left")
        out = np.empty((len(marks), turns), np.uint32)
        padded = np.frombuffer(data + bytes(4), np.uint8).astype(np.uint32)
        window = padded[:-3] << 24 | padded[1:-2] << 16 | padded[2:-1] << 8 | padded[3:]
        shift = np.uint32(32 - self.limit)
        for k, n in enumerate(active.tolist()):
            place = place[:n]
            entry = self.table[window[place >> 3] << (place & 7).astype(np.uint32) >> shift]
            out[:n, k] = entry >> np.uint32(5)
            place = place + (entry & np.uint32(31))
        ids = np.empty_like(out)
        ids[longest_first] = out
        return ids[np.arange(turns) < counts[:, None]]
