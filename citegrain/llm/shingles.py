"""Word shingles of whole texts as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

REMEMBERED_WORDS = 250_000
_C = tuple(np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Shingler:
    """Words are the runs of bytes that aren't ASCII white space, with A-Z lower-cased."""

    def __init__(self, width: int = 3):
        self.width, self.words = width, {}

    def word_hashes(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        known = self.words
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) > REMEMBERED_WORDS:
                known.clear()
            hashed = xxhash.xxh64_intdigest
            for w in words:
                if w not in known:
                    known[w] = hashed(w)
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def __call__(self, text: str | None) -> np.ndarray:
        """Distinct shingles in ascending order; a text of fewer words is one shingle, one without words none."""
        h = self.word_hashes(text)
        if not len(h):
            return h
        k = min(self.width, len(h))
        with np.errstate(over="ignore"):
            total = np.full(len(h) - k + 1, k, np.uint64)
            for i in range(k):
                total = mixed(total * _C[0] + h[i : len(h) - k + 1 + i] + _C[1])
        return np.unique(total)


def set_key(shingles: np.ndarray) -> int:
    """A signed 64-bit key of a whole set; 0 is the empty set's."""
    if not len(shingles):
        return 0
    key = xxhash.xxh64_intdigest(shingles.tobytes()) or 1
    return key - (1 << 64) if key >> 63 else key
