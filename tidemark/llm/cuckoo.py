"""Cuckoo filter over 64-bit hashes, in numpy: inserts, deletes and lookups of whole arrays."""

from __future__ import annotations

import numpy as np

SLOTS = 4
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class CuckooFilter:
    """Four 16-bit fingerprints a bucket; a fingerprint's other bucket is found from the fingerprint alone, so entries
    can move and be deleted. One copy is held of each inserted hash: insert a hash once, and delete only what was inserted."""

    def __init__(self, capacity: int, table: np.ndarray | None = None):
        self.buckets = 1 << max(2, int(np.ceil(np.log2(max(capacity, 1) / (SLOTS * 0.85)))))
        self.table = np.zeros((self.buckets, SLOTS), np.uint16) if table is None else table
        self._rng = np.random.default_rng(17)

    @classmethod
    def from_bytes(cls, blob: bytes) -> CuckooFilter:
        table = np.frombuffer(blob, np.uint16).reshape(-1, SLOTS).copy()
        out = cls(1, table)
        out.buckets = len(table)
        return out

    @classmethod
    def build(cls, hashes: np.ndarray) -> CuckooFilter:
        size = len(hashes)
        while True:
            out = cls(size)
            if out.insert(hashes):
                return out
            size = max(2 * size, 8)

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def _places(self, hashes: np.ndarray):
        with np.errstate(over="ignore"):
            h = hashes.astype(np.int64).view(np.uint64) * _M1
            h ^= h >> np.uint64(32)
            print_ = ((h >> np.uint64(40)) & np.uint64(0xFFFF)).astype(np.uint16)
            print_[print_ == 0] = 1
            first = (h & np.uint64(self.buckets - 1)).astype(np.int64)
        return print_, first, self._other(first, print_)

    def _other(self, bucket, print_):
        with np.errstate(over="ignore"):
            step = (np.asarray(print_, np.uint64) * _M2 >> np.uint64(20)) & np.uint64(self.buckets - 1)
        return np.asarray(bucket ^ step.astype(np.int64))

    def _put(self, print_, bucket) -> np.ndarray:
        """Place at most one entry per bucket and call; returns which entries were placed."""
        placed = np.zeros(len(print_), bool)
        _, pick = np.unique(bucket, return_index=True)
        free = self.table[bucket[pick]] == 0
        fits = free.any(1)
        pick = pick[fits]
        self.table[bucket[pick], free[fits].argmax(1)] = print_[pick]
        placed[pick] = True
        return placed

    def insert(self, hashes: np.ndarray) -> bool:
        """False if the filter is too full; the caller then builds a larger one from the exact table."""
        print_, first, second = self._places(np.asarray(hashes))
        for _ in range(4 * SLOTS):
            if not len(print_):
                return True
            rest = ~self._put(print_, first)
            print_, first, second = print_[rest], second[rest], first[rest]
        for p, b in zip(print_.tolist(), first.tolist(), strict=True):
            for _ in range(500):
                row = self.table[b]
                free = np.flatnonzero(row == 0)
                if len(free):
                    row[free[0]] = p
                    break
                k = int(self._rng.integers(SLOTS))
                p, row[k] = int(row[k]), p
                b = int(self._other(np.array([b]), np.array([p]))[0])
            else:
                return False
        return True

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        print_, first, second = self._places(np.asarray(hashes))
        return (self.table[first] == print_[:, None]).any(1) | (self.table[second] == print_[:, None]).any(1)

    def delete(self, hashes: np.ndarray) -> None:
        for p, *at in zip(*(x.tolist() for x in self._places(np.asarray(hashes))), strict=True):
            for b in at:
                hit = np.flatnonzero(self.table[b] == p)
                if len(hit):
                    self.table[b, hit[0]] = 0
                    break
