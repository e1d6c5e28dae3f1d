"""Sets of word shingles as arrays of 64-bit hashes, for use inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

_WORD = xxhash.xxh3_64_intdigest
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64(32)


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text, A-Z lower-cased: bytes methods touch ASCII only, which is the rule."""
    return (text or b"").lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_WORD, words), np.uint64, len(words))


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of ``width`` words, in order; fewer words make one shingle."""
    count = len(hashes)
    if count == 0:
        return hashes
    width = min(width, count)
    found = np.full(count - width + 1, width, np.uint64)
    for i in range(width):
        found *= _STEP
        found += hashes[i : count - width + 1 + i]
        found ^= found >> _HALF
        found *= _MIX
    found ^= found >> _HALF
    return found


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text; empty without words."""
    return np.unique(shingle_hashes(word_hashes(words_of(text)), width))


def multipliers(count: int, seed: int) -> np.ndarray:
    """Odd numbers that turn one 64-bit hash into ``count`` different ones."""
    return np.random.default_rng(seed).integers(1, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a)) if len(b) else 0
