"""Words of a text as 64-bit codes, and hashes of word runs, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import WORD

#: Words of which a worker remembers the codes.
HELD = 500_000


class WordCodes(dict):
    """word -> 64-bit code, the same in every task."""

    def __missing__(self, word: str) -> int:
        code = self[word] = xxhash.xxh3_64_intdigest(word.encode())
        return code

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > HELD:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: str) -> list[str]:
    return WORD.findall(text)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    out = np.zeros(max(0, len(codes) - n + 1), np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + codes[k:len(codes) - n + 1 + k]
    return mixed(out)
