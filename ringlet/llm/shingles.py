"""Shingle sets and circulant MinHash signatures of texts, with numpy."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS, BANDS, ROWS = 5, 32, 4
COORDS = BANDS * ROWS
#: Words whose hashes a worker remembers within a partition: some 10 MB.
_WORD_CACHE = 65_536
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_P1, _P2 = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)
_SHIFTS = np.arange(1, COORDS + 1, dtype=np.uint32)[:, None]


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _WordHashes()


def forget() -> None:
    """Empty this worker's cache."""
    _words.clear()


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles; the whole text if it is shorter.

    bytes.lower() folds A-Z only and bytes.split() splits at space and \\t \\n \\v \\f \\r only.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64)
    if len(_words) > _WORD_CACHE:
        _words.clear()
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = len(words) - WORDS + 1
    h = w[:n] * _C1
    for k in range(1, WORDS):
        h ^= h >> np.uint64(31)
        h *= _C2
        h += w[k : n + k]
    h ^= h >> np.uint64(30)
    h *= _C3
    h ^= h >> np.uint64(31)
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def signature(hashes: np.ndarray) -> np.ndarray:
    """Circulant MinHash: one permutation scatters the set over 32 bits; coordinate k is the
    smallest value of the second permutation shifted circularly by k."""
    scattered = ((hashes * _C2) >> np.uint64(32)).astype(np.uint32)
    best = np.full(COORDS, np.uint32(0xFFFFFFFF))
    for at in range(0, len(scattered), 2048):
        x = scattered[None, at : at + 2048] - _SHIFTS
        x *= _P1
        x ^= x >> np.uint32(15)
        x *= _P2
        x ^= x >> np.uint32(13)
        x *= _P1
        np.minimum(best, x.min(axis=1), out=best)
    return best


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of ``ROWS`` coordinates."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _C1
    for column in sig.reshape(BANDS, ROWS).T.astype(np.uint64):
        key = (key ^ column) * _C2
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0
