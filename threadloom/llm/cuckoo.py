"""A cuckoo filter over 64-bit keys, with vectorised lookups and deletion of stored keys."""

from __future__ import annotations

import numpy as np

from .core import U64, mix

SLOTS = 4


class CuckooFilter:
    """16-bit fingerprints in buckets of four slots. Absent keys are told absent except about one in 8,000.

    A key that was added (and not removed as often as added) is always found. Where an insertion finds
    no room, the caller makes a larger filter from the exact tables behind it, so keys are never lost.
    Only keys that are stored may be removed.
    """

    def __init__(self, capacity: int):
        self.bits = max(4, int(np.ceil(np.log2(max(1, capacity) / SLOTS / 0.85))))
        self.table = np.zeros((1 << self.bits, SLOTS), np.uint16)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix(keys.astype(U64))
        finger = ((h >> U64(48)) | U64(1)).astype(np.uint16)
        first = (h & U64((1 << self.bits) - 1)).astype(np.int64)
        return finger, first, first ^ self._jump(finger)

    def _jump(self, finger):
        return (mix(np.atleast_1d(finger).astype(U64)) & U64((1 << self.bits) - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        finger, a, b = self._places(np.asarray(keys))
        return (self.table[a] == finger[:, None]).any(axis=1) | (self.table[b] == finger[:, None]).any(axis=1)

    def remove(self, key: int) -> bool:
        finger, a, b = (x[0] for x in self._places(np.array([key], U64)))
        for at in (a, b):
            slot = np.flatnonzero(self.table[at] == finger)
            if len(slot):
                self.table[at, slot[0]] = 0
                return True
        return False

    def add(self, key: int) -> bool:
        """False if there was no room; the filter then no longer holds one of its keys."""
        finger, a, b = (x[0] for x in self._places(np.array([key], U64)))
        for at in (a, b):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = finger
                return True
        for kick in range(500):
            slot = kick % SLOTS
            finger, self.table[a, slot] = self.table[a, slot], finger
            a = int(a) ^ int(self._jump(finger)[0])
            free = np.flatnonzero(self.table[a] == 0)
            if len(free):
                self.table[a, free[0]] = finger
                return True
        return False

    def add_all(self, keys: np.ndarray) -> bool:
        """Adds distinct keys; those whose first free slot can be told at once go in together. False as in add()."""
        left = np.asarray(keys).astype(U64)
        for side in (1, 2):
            for slot in range(SLOTS):
                if not len(left):
                    return True
                places = self._places(left)
                at, finger = places[side], places[0]
                free = self.table[at, slot] == 0
                _, firsts = np.unique(at[free], return_index=True)
                chosen = np.flatnonzero(free)[firsts]
                self.table[at[chosen], slot] = finger[chosen]
                left = np.delete(left, chosen)
        return all(self.add(int(k)) for k in left)

    def room(self) -> int:
        """Keys that still go in easily."""
        return int(self.table.size * 0.9) - int(np.count_nonzero(self.table))

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        """A filter of distinct keys."""
        keys = np.unique(np.asarray(keys).astype(U64))
        size = len(keys)
        while True:
            out = cls(size)
            if out.add_all(keys):
                return out
            size = int((1 << out.bits) * SLOTS * 0.86) + SLOTS

    def to_bytes(self) -> bytes:
        return bytes([self.bits]) + self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        out = cls.__new__(cls)
        out.bits = data[0]
        out.table = np.frombuffer(data, np.uint16, offset=1).reshape(-1, SLOTS).copy()
        return out
