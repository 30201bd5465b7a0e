"""What a Python worker keeps from task to task.

Spark's workers live over many tasks of different operators. Only one operator's tables are kept
at a time, so the memory of a worker is that of the operator it runs, not a sum over all before.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable

import numpy as np

_held: dict[Hashable, object] = {}


def kept(key: Hashable, make: Callable[[], object]) -> object:
    """What make builds, kept in this process until another key is asked for."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def release() -> None:
    _held.clear()


class KeyTable:
    """Places 0, 1, 2, ... of 64-bit keys that are hashes already: two arrays, probed for all keys at once."""

    def __init__(self, most: int):
        self.most = most
        self.mask = (1 << (2 * most - 1).bit_length()) - 1
        self.clear()

    def clear(self) -> None:
        self.n = 0
        self.key, self.place = np.zeros(self.mask + 1, np.uint64), np.full(self.mask + 1, -1, np.int32)

    def __len__(self) -> int:
        return self.n

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for unknown ones."""
        out = np.full(len(keys), -1, np.int64)
        slot, rest = (keys & np.uint64(self.mask)).astype(np.int64), np.arange(len(keys))
        while len(rest):
            at = slot[rest]
            place = self.place[at]
            same = (place >= 0) & (self.key[at] == keys[rest])
            out[rest[same]] = place[same]
            rest = rest[(place >= 0) & ~same]
            slot[rest] = (slot[rest] + 1) & self.mask
        return out

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Places for distinct keys that aren't known; no more than most altogether."""
        places = self.n + np.arange(len(keys))
        slot, rest = (keys & np.uint64(self.mask)).astype(np.int64), np.arange(len(keys))
        while len(rest):
            at = slot[rest]
            free = self.place[at] < 0
            _, one = np.unique(at[free], return_index=True)
            won = rest[free][one]
            self.key[slot[won]], self.place[slot[won]] = keys[won], places[won]
            rest = np.setdiff1d(rest, won, assume_unique=True)
            slot[rest] = (slot[rest] + 1) & self.mask
        self.n += len(keys)
        return places
