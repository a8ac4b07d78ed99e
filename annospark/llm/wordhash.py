"""64-bit hashes of words, and of runs of words.

A word has the xxh3 hash of its bytes.  A run's hash is made by doubling: that of its
first words, mixed with that of its last words, where the two may overlap.  Each
step mixes all bits of two hashes, so runs of different words collide by chance
only, with probability 2^-64 a pair, however long or regular their words are.
"""

from __future__ import annotations

import numpy as np
import xxhash

from annospark.llm.common import shipped

ODD = np.uint64(0x9E3779B97F4A7C15)
KEPT_WORDS, LONGEST_KEPT = 100_000, 64            # words that a worker remembers, and their bytes


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHashes(dict):
    """word -> hash, of the words met last."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONGEST_KEPT:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > KEPT_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


class Runs:
    """Hashes of the runs of a sequence of word hashes."""

    def __init__(self, words: np.ndarray):
        self.known = {1: words}

    def of(self, length: int) -> np.ndarray:
        """One hash for each run of so many words, in order of their places."""
        if length not in self.known:
            half = 1 << (length - 1).bit_length() - 1       # the largest power of two below the length
            h = self.of(half)
            n, shift = len(self.known[1]) - length + 1, length - half
            self.known[length] = mixed(h[:n] * ODD + h[shift:shift + n])
        return self.known[length]


shipped(__name__)
