"""Minimal perfect hash over pairs of 64-bit hashes, in numpy: levels of bits with ranks.

At a level each key still without a place takes a position; keys alone at theirs keep it, the others go to the next
level. The place of a key is the rank of its bit over all levels, so n keys have the places 0 to n - 1.
"""

from __future__ import annotations

import pickle

import numpy as np

LOAD = 2  # positions of a level for each key that comes to it
MOST_LEVELS = 64


def _position(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    x = h1 + np.uint64(level + 1) * (h2 | np.uint64(1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


class Index:
    """The hash function of distinct keys and, by place, their fingerprints, counts and first documents."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, firsts: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, np.ndarray, int]] = []  # size, bits, rank before each byte, places before
        left, before = np.arange(len(h1)), 0
        while len(left):
            if len(self.levels) == MOST_LEVELS:
                raise ValueError("keys are not distinct")
            size = LOAD * len(left) + 64
            at = _position(h1[left], h2[left], len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            bits = np.packbits(alone, bitorder="little")
            ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.uint32)[:-1]]).astype(np.uint32)
            self.levels.append((size, bits, ranks, before))
            before += int(alone.sum())
            left = left[~alone[at]]
        place = self.places(h1, h2)
        self.prints, self.counts, self.firsts = np.zeros(len(h1), np.uint32), np.zeros(len(h1), np.uint32), np.zeros(len(h1), np.int64)
        self.prints[place] = h2.astype(np.uint32)
        self.counts[place] = np.minimum(counts, 0xFFFFFFFF)
        self.firsts[place] = firsts

    def places(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Place of each key, -1 where no level has a bit for it."""
        out, left = np.full(len(h1), -1, np.int64), np.arange(len(h1))
        for level, (size, bits, ranks, before) in enumerate(self.levels):
            at = _position(h1[left], h2[left], level, size)
            byte, bit = at >> 3, (at & 7).astype(np.uint8)
            value = bits[byte]
            has = (value >> bit) & 1 == 1
            below = np.bitwise_count(value & ((np.uint8(1) << bit) - np.uint8(1)))
            out[left[has]] = before + ranks[byte[has]].astype(np.int64) + below[has]
            left = left[~has]
            if not len(left):
                break
        return out

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each key whether the index has it (by its fingerprint), its count and its first document."""
        place = self.places(h1, h2)
        if not len(self.prints):
            none = np.zeros(len(h1), np.int64)
            return none.astype(bool), none, none
        found = (place >= 0) & (self.prints[place] == h2.astype(np.uint32))
        return found, np.where(found, self.counts[place], 0), self.firsts[place]

    def dump(self) -> bytes:
        return pickle.dumps(self.__dict__, protocol=5)

    @staticmethod
    def load(raw: bytes) -> Index:
        index = Index.__new__(Index)
        index.__dict__.update(pickle.loads(raw))
        return index
