"""Word and shingle sets of texts, for use inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE = 5
_POWERS = np.array([pow(0x9E3779B97F4A7C15 | 1, SHINGLE - 1 - i, 1 << 64) for i in range(SHINGLE)], np.uint64)


class WordHashes(dict):
    """Word -> 64-bit hash; remembers a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def words(text: str | None) -> list[bytes]:
    """Words between ASCII white space (space, tab to carriage return), A-Z lower-cased; none for null."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """Spread of 64-bit values (finalizer of a splittable generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit values of the 5-word shingles; fewer words are one shingle; no words, none."""
    seq = words(text)
    if not seq:
        return np.empty(0, np.uint64)
    if len(seq) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(seq), seed=len(seq))], np.uint64)
    h = np.fromiter(map(hashes.__getitem__, seq), np.uint64, len(seq))
    n = len(seq) - SHINGLE + 1
    total = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        total += h[i:i + n] * _POWERS[i]
    return np.unique(mix(total))
