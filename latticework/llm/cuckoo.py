"""A cuckoo filter over 16-byte keys: inserts, deletions, no false negatives."""

from __future__ import annotations

import numpy as np

SLOTS = 4
KICKS = 500


def _split(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket hash and 16-bit tag (never zero) of keys given as rows of two uint64."""
    tag = (keys[:, 1] >> np.uint64(48)).astype(np.uint16)
    return keys[:, 0], np.where(tag == 0, np.uint16(1), tag)


def as_rows(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)


class CuckooFilter:
    """Tags live in one of two buckets of four; the second is found from the first and the tag alone.

    A key inserted twice takes two places, so callers insert a key once and keep counts
    in an exact table. When an insertion finds no place the filter answers False and
    stays as it was; the caller builds a larger one from the exact table.
    """

    def __init__(self, capacity: int, table: bytes | None = None) -> None:
        buckets = 1
        while buckets * SLOTS * 0.85 < max(1, capacity):
            buckets *= 2
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else np.frombuffer(table, np.uint16).reshape(-1, SLOTS).copy()
        self.mask = np.uint64(len(self.table) - 1)

    @classmethod
    def from_bytes(cls, table: bytes) -> CuckooFilter:
        return cls(1, table)

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def _buckets(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        spread, tag = _split(keys)
        first = spread & self.mask
        return first, (first ^ self._jump(tag)) & self.mask, tag

    def _jump(self, tag: np.ndarray) -> np.ndarray:
        return (tag.astype(np.uint64) * np.uint64(0x5BD1E995)) >> np.uint64(3)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        first, second, tag = self._buckets(keys)
        return (self.table[first] == tag[:, None]).any(axis=1) | (self.table[second] == tag[:, None]).any(axis=1)

    def insert(self, keys: np.ndarray) -> bool:
        """Insert all keys, or none and return False."""
        before = self.table.copy()
        for first, second, tag in zip(*(x.tolist() for x in self._buckets(keys)), strict=True):
            if not (self._place(first, tag) or self._place(second, tag) or self._kick(second, tag)):
                self.table = before
                return False
        return True

    def _place(self, bucket: int, tag: int) -> bool:
        row = self.table[bucket]
        for k in range(SLOTS):
            if row[k] == 0:
                row[k] = tag
                return True
        return False

    def _kick(self, bucket: int, tag: int) -> bool:
        for n in range(KICKS):
            k = (n * 7 + tag) % SLOTS
            self.table[bucket, k], tag = tag, int(self.table[bucket, k])
            bucket = (bucket ^ int(self._jump(np.uint16(tag)))) & int(self.mask)
            if self._place(bucket, tag):
                return True
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Remove one copy of each key, all of which were inserted before."""
        for first, second, tag in zip(*(x.tolist() for x in self._buckets(keys)), strict=True):
            for bucket in (first, second):
                at = np.flatnonzero(self.table[bucket] == tag)
                if len(at):
                    self.table[bucket, at[0]] = 0
                    break
