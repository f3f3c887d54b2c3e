"""Vectorised 64-bit hashing of words and word shingles."""

from __future__ import annotations

import numpy as np
import xxhash

_M1 = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)
_R = np.uint64(33)
_C = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """word (bytes) -> 64-bit hash; a memo that is emptied when it reaches its bound."""

    def __init__(self, bound: int = 100_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (wraps modulo 2**64)."""
    x = (x ^ (x >> _R)) * _M1
    x = (x ^ (x >> _R)) * _M2
    return x ^ (x >> _R)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; with fewer words, of the whole sequence; none without words."""
    n = len(hashes)
    if n == 0:
        return hashes
    k = min(k, n)
    out = hashes[: n - k + 1].copy()
    for j in range(1, k):
        out = out * _C + hashes[j : n - k + 1 + j]
    return mix(out + np.uint64(k))
