"""A hash table over integer arrays."""

from __future__ import annotations

import numpy as np


class Slots:
    """Open addressing over integer keys of at least 0; a probe is two gathers instead of a binary search."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = int(len(keys) * 2 + 1).bit_length()
        self.keys, self.values = np.full(1 << self.bits, -1, dtype=np.int64), np.full(1 << self.bits, -1, dtype=np.int64)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            at, first = np.unique(slot[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[at], self.values[at] = keys[won], values[won]
            rest = np.ones(len(keys), dtype=bool)
            rest[won] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def __reduce__(self):
        full = self.keys >= 0
        return Slots, (self.keys[full], self.values[full].astype(np.int32) if len(self.values) < 1 << 30 else self.values[full])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, or -1."""
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], -1)
        left = np.flatnonzero((held != keys) & (held >= 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot]
            hit = held == keys[left]
            out[left[hit]] = self.values[slot[hit]]
            on = ~hit & (held >= 0)
            left, slot = left[on], slot[on]
        return out


class Numbers(dict):
    """Numbers its keys as they are first asked for."""

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        return n
