"""Static binary-fuse filters: a set of 64-bit keys as about 9 bits a key, without false negatives.

Each key has one slot in each of three neighbouring segments, and the three fingerprints there xor to the key's own; a
key outside the set passes with probability 1/256.  Slots are assigned by peeling: a slot that only one key uses is
given to it, the key goes, and so on.  Here a whole generation of such slots is peeled at once with numpy: two keys of
one generation never use each other's slot, so generations can be filled in reverse order, each in one step.
"""

from __future__ import annotations

import math

import numpy as np

from .common import mix

TRIES = 100


class Fuse:
    def __init__(self, seed: int, segment: int, segments: int, prints: np.ndarray):
        self.seed, self.segment, self.segments, self.prints = seed, segment, segments, prints

    @staticmethod
    def _slots(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
        """(3, n) slots and the fingerprints of the keys."""
        h = mix(keys.astype(np.uint64) + mix(np.array([seed + 1], np.uint64)))
        first = (h >> np.uint64(32)) * np.uint64(segment * segments) >> np.uint64(32)
        low = np.uint64(segment - 1)
        slots = np.stack([first, (first + np.uint64(segment)) ^ (h >> np.uint64(18) & low),
                          (first + np.uint64(2 * segment)) ^ (h & low)]).astype(np.int64)
        return slots, (mix(h) & np.uint64(0xFF)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> Fuse:
        """The filter of the distinct keys; the same keys always give the same filter."""
        keys = np.unique(keys.astype(np.uint64))
        n = len(keys)
        if not n:
            return cls(0, 0, 0, np.empty(0, np.uint8))
        # sizes from the published analysis of 3-wise binary fuse filters
        segment = 1 << max(2, math.floor(math.log(n) / math.log(3.33) + 2.25))
        room = math.ceil(n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))) + 8
        segments = max(1, -(-room // segment) - 2)
        for seed in range(TRIES):
            slots, prints = cls._slots(keys, seed, segment, segments)
            out = _assigned(slots, prints, segment * (segments + 2))
            if out is not None:
                return cls(seed, segment, segments, out)
        raise RuntimeError(f"no filter for {n} keys after {TRIES} seeds")

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """False only for keys that are not in the set."""
        if not len(self.prints):
            return np.zeros(len(keys), bool)
        slots, prints = self._slots(keys, self.seed, self.segment, self.segments)
        return np.bitwise_xor.reduce(self.prints[slots], axis=0) == prints


def _assigned(slots: np.ndarray, prints: np.ndarray, size: int) -> np.ndarray | None:
    """Fingerprints by slot, or None if the keys cannot all be peeled."""
    n = slots.shape[1]
    uses = np.bincount(slots.ravel(), minlength=size)
    who = np.zeros(size, np.int64)  # xor of the numbers of the keys that use a slot
    for row in slots:
        np.bitwise_xor.at(who, row, np.arange(n))
    generations, gone, free = [], 0, np.flatnonzero(uses == 1)
    while len(free):
        keys, at = np.unique(who[free], return_index=True)  # a key that is alone in several slots takes one
        generations.append((keys, free[at]))
        gone += len(keys)
        for row in slots[:, keys]:
            np.subtract.at(uses, row, 1)
            np.bitwise_xor.at(who, row, keys)
        touched = np.unique(slots[:, keys])
        free = touched[uses[touched] == 1]
    if gone < n:
        return None
    out = np.zeros(size, np.uint8)
    for keys, own in reversed(generations):
        out[own] = 0
        out[own] = prints[keys] ^ np.bitwise_xor.reduce(out[slots[:, keys]], axis=0)
    return out
