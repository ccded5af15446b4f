"""Hashed word shingles of whole texts, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

#: Fixed odd multipliers of the 64-bit mixer.
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_R = np.uint64(0x9E3779B97F4A7C15)
#: A to Z to lower case, all other bytes as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word; bytes.split() cuts at ASCII white space only."""
    words = text.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """The sorted distinct hashes of ``size`` words in a row; of the whole sequence where there are fewer words."""
    words = word_hashes((text or "").encode().translate(LOWER))
    if not len(words):
        return words
    if len(words) < size:
        total = np.array([len(words)], np.uint64)
        for k in range(len(words)):
            total = mixed(total * _R + words[k : k + 1])
        return total
    total = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        total = mixed(total * _R + words[k : len(words) - size + 1 + k])
    return np.unique(total)
