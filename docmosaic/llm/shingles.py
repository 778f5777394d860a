"""Sets of word shingles as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

from docmosaic.llm.common import mixed

_CACHE = 300_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Hash of a word, remembered; forgets all when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased, cut at ASCII white space."""
    return text.lower().split()


def shingle_set(text: bytes, size: int, hashes: WordHashes) -> np.ndarray:
    """Distinct hashes of all runs of ``size`` words; of the whole sequence if it is shorter; none without words."""
    words = words_of(text)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    width = min(size, len(h))
    out = h[: len(h) - width + 1].copy()
    for j in range(1, width):
        out *= _STEP
        out += h[j : len(h) - width + 1 + j]
    return np.unique(mixed(out ^ np.uint64(width)))
