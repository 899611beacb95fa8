"""Word shingles as sets of 64-bit hashes, in NumPy, for Arrow batches."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers and shifts of the splitmix64 finaliser.
_M1, _M2, _GOLDEN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)
_CACHE_WORDS = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


class WordHashes(dict):
    """Hashes of words, kept for reuse up to a number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: bytes | None, k: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles: words are runs between ASCII white space, A-Z
    lower-cased; a text of fewer words, but not none, is one shingle."""
    w = (text or b"").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, w), np.uint64, len(w))
    n = max(1, len(h) - k + 1)
    out = np.full(n, min(k, len(h)), np.uint64)
    for j in range(min(k, len(h))):
        out = mix(out * _GOLDEN + h[j : j + n])
    return np.unique(out)


def minhashes(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each hash function (a, b) over a set that isn't empty."""
    best = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        np.minimum(best, (shingles[at : at + 2048, None] * a + b).min(axis=0), out=best)
    return best
