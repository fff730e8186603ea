"""Minimal perfect hashing: distinct 64-bit keys to 0 .. n - 1 in about three bits a key.

Level by level, each key picks a place in a bit array; those alone at their place keep it, the others go to
the next level. A key's number is the rank of its place among all kept places.
"""

from __future__ import annotations

import numpy as np

GAMMA = 1.7  # places per key of a level


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    def __init__(self, keys: np.ndarray):
        """keys: distinct, unsigned 64 bits."""
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []  # places, bits, kept places before each word
        self.size, left, before = len(keys), keys, 0
        while len(left):
            places = max(64, int(len(left) * GAMMA) + 63 & ~63)
            at = (mixed(left, len(self.levels)) % np.uint64(places)).astype(np.int64)
            alone = np.bincount(at, minlength=places) == 1
            words = np.packbits(alone, bitorder="little").view(np.uint64)
            count = np.bitwise_count(words).astype(np.int64)
            self.levels.append((places, words, before + np.cumsum(count) - count))
            before += int(count.sum())
            left = left[~alone[at]]

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the keys; of a key that was not given, any number or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for k, (places, words, before) in enumerate(self.levels):
            at = (mixed(keys[left], k) % np.uint64(places)).astype(np.int64)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[left[hit]] = (before[at >> 6] + below)[hit]
            left = left[~hit]
            if not len(left):
                break
        return out

    def bits(self) -> int:
        return sum(64 * len(words) for _, words, _ in self.levels)
