"""The guards of answer reuse over two blocks of questions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Machine words of common content words that are held at once.
HELD = 1 << 20


def _codes(left: pa.Table, right: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Numbers of both sides' values, -1 for null, and the values."""
    coded = pa.concat_arrays([t.column(name).combine_chunks() for t in (left, right)]).dictionary_encode()
    codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return codes[: left.num_rows], codes[left.num_rows :], coded.dictionary


class Guard:
    """Tells of rows of two tables with the fields of `question_traits` whether `rejection_reason` is null."""

    def __init__(self, left: pa.Table, right: pa.Table, min_overlap: float):
        self.min_overlap = min_overlap
        self.alike, self.compared = _codes(left, right, "alike")[:2], _codes(left, right, "compared")[:2]
        *self.texts, texts = _codes(left, right, "words")
        words = pc.split_pattern(pc.if_else(pc.equal(texts, ""), None, texts), " ")
        self.sizes = pc.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False)
        codes = words.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(len(self.sizes)), self.sizes)
        # a word of one text alone is common to none; the others have a bit each
        common = np.bincount(codes) > 1
        rows, codes = rows[common[codes]], (np.cumsum(common) - 1)[codes[common[codes]]]
        self.bits = np.zeros((len(self.sizes), int(common.sum()) // 64 + 1), np.uint64)
        np.bitwise_or.at(self.bits, (rows, codes // 64), np.uint64(1) << (codes % 64).astype(np.uint64))

    def overlap(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Jaccard similarity of content words; 0 where a side has none."""
        step = max(1, HELD // self.bits.shape[1])
        parts = [np.bitwise_count(self.bits[a[i : i + step]] & self.bits[b[i : i + step]]).sum(axis=1, dtype=np.int64) for i in range(0, len(a), step)]
        both = np.where(a == b, self.sizes[a], np.concatenate([np.zeros(0, np.int64), *parts]))
        return np.where((self.sizes[a] > 0) & (self.sizes[b] > 0), both / np.maximum(self.sizes[a] + self.sizes[b] - both, 1), 0.0)

    def allows(self, q: np.ndarray, c: np.ndarray) -> np.ndarray:
        alike, compared = self.alike[0][q], (self.compared[0][q], self.compared[1][c])
        ok = (alike == self.alike[1][c]) & (alike >= 0) & ((compared[0] == compared[1]) | (compared[0] < 0) | (compared[1] < 0))
        at = np.flatnonzero(ok)
        ok[at] = self.overlap(self.texts[0][q[at]], self.texts[1][c[at]]) >= self.min_overlap
        return ok
