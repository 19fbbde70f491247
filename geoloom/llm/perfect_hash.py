"""A minimal perfect hash over 128-bit keys, with a fingerprint and values for each key.

Level by level, keys are dealt to about ``ROOM`` bits a key; a bit that just one
key hits is set and is that key's, the others go on to the next level.  A
key's number is the rank of its bit among all set bits, so n keys get the
numbers 0 to n - 1 in about four bits a key.  Building and lookups are whole
array operations.
"""

from __future__ import annotations

import struct

import numpy as np

#: Bits a key at each level.
ROOM = 2
LEVELS = 40


def _mixed(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    x = a ^ (b * np.uint64(2 * level + 0x9E3779B97F4A7C15 & (1 << 64) - 1 | 1))
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _marks(a: np.ndarray) -> np.ndarray:
    """The fingerprint of keys whose second half is ``a``."""
    return (a >> np.uint64(32)).astype("u4")


class PerfectHash:
    """Numbers for the keys (a, b) it was built from: unsigned 64-bit arrays, distinct as pairs."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.levels: list[np.ndarray] = []
        # every level leaves about two keys in five; pairs that differ part sooner or later
        while len(a):
            if len(self.levels) == LEVELS:
                raise ValueError("keys repeat")
            bits = max(64, -(-ROOM * len(a) // 64) * 64)
            at = (_mixed(a, b, len(self.levels)) % np.uint64(bits)).astype("i8")
            hits = np.bincount(at, minlength=bits)
            self.levels.append(np.packbits(hits == 1, bitorder="little").view("<u8"))
            left = hits[at] != 1
            a, b = a[left], b[left]
        self._rank()

    def _rank(self) -> None:
        self.before, total = [], 0
        for words in self.levels:
            ends = np.cumsum(np.bitwise_count(words).astype("i8"))
            self.before.append(total + np.concatenate([[0], ends[:-1]]))
            total += int(ends[-1])
        self.n = total

    def numbers(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of each key; any number, or -1, for keys it doesn't know."""
        out, rows = np.full(len(a), -1, "i8"), np.arange(len(a))
        for level, words in enumerate(self.levels):
            if not len(rows):
                break
            at = _mixed(a[rows], b[rows], level) % np.uint64(64 * len(words))
            word, bit = (at >> np.uint64(6)).astype("i8"), at & np.uint64(63)
            hit = (words[word] >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype("i8")
            out[rows[hit]] = (self.before[level][word] + below)[hit]
            rows = rows[~hit]
        return out

    def to_bytes(self) -> bytes:
        return struct.pack("<i", len(self.levels)) + b"".join(struct.pack("<q", len(w)) + w.tobytes() for w in self.levels)

    @classmethod
    def from_bytes(cls, raw: bytes) -> tuple[PerfectHash, int]:
        """The hash and where its bytes end."""
        made, at = cls.__new__(cls), 4
        made.levels = []
        for _ in range(struct.unpack_from("<i", raw)[0]):
            size = struct.unpack_from("<q", raw, at)[0]
            made.levels.append(np.frombuffer(raw, "<u8", size, at + 8))
            at += 8 + 8 * size
        made._rank()
        return made, at


def pack(a: np.ndarray, b: np.ndarray, counts: np.ndarray, owners: np.ndarray) -> bytes:
    """One shard: the hash, then a 32-bit fingerprint, a 32-bit count and a 64-bit owner for each number."""
    made = PerfectHash(a, b)
    order = np.argsort(made.numbers(a, b))
    columns = (_marks(b), np.minimum(counts, 2**32 - 1).astype("<u4"), owners.astype("<i8"))
    return made.to_bytes() + b"".join(c[order].tobytes() for c in columns)


class Shard:
    """A packed shard, to be probed."""

    def __init__(self, raw: bytes):
        self.hash, at = PerfectHash.from_bytes(raw)
        n = self.hash.n
        self.marks = np.frombuffer(raw, "<u4", n, at)
        self.counts = np.frombuffer(raw, "<u4", n, at + 4 * n)
        self.owners = np.frombuffer(raw, "<i8", n, at + 8 * n)

    def probe(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, owner) of each key; count 0 where the number is none or the fingerprint is another."""
        at = self.hash.numbers(a, b)
        known = at >= 0
        known[known] = self.marks[at[known]] == _marks(b[known])
        at = np.where(known, at, 0)
        if not self.hash.n:
            return np.zeros(len(a), "i8"), np.zeros(len(a), "i8")
        return np.where(known, self.counts[at], 0).astype("i8"), self.owners[at]
