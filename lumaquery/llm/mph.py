"""A minimal perfect hash over the 64-bit keys of one shard, with fingerprints.

Level by level, keys that fall alone on a bit of that level's bit array own it;
the others go on to the next level.  A key's slot is the number of set bits
before its own.  A stored 32-bit fingerprint rejects keys that were never added.
"""

from __future__ import annotations

import numpy as np

#: Bits a key in each level's array.
GAMMA = 2.0


def _scramble(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys.astype(np.int64).view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    def __init__(self, levels: list[np.ndarray], fingerprints: np.ndarray):
        self.levels, self.fingerprints = levels, fingerprints
        self.ranks, seen = [], 0
        for bits in levels:
            self.ranks.append(seen + np.cumsum(bits) - bits)
            seen += int(bits.sum())

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """From distinct keys."""
        levels, left = [], keys
        while len(left):
            size = max(8, int(GAMMA * len(left)))
            at = (_scramble(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        out = cls(levels, np.zeros(len(keys), np.uint32))
        out.fingerprints[out._slot(keys)] = _fingerprint(keys)
        return out

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 where no level has it."""
        slot, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            at = (_scramble(keys[todo], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            slot[todo[hit]] = self.ranks[level][at[hit]]
            todo = todo[~hit]
        return slot

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 for a key that wasn't added (but for one in 2**32)."""
        slot = self._slot(keys)
        there = slot >= 0
        there[there] = self.fingerprints[slot[there]] == _fingerprint(keys[there])
        return np.where(there, slot, -1)


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_scramble(keys, 777) >> np.uint64(32)).astype(np.uint32)
