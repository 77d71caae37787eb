"""Exact token counts of every prefix, by dynamic programming over token ends.

For a merge-ordered vocabulary the encoding of a prefix ends in the one token t that is compatible
with the last token of what stands before it (merging the two tokens' text gives just those two),
so count(prefix) = count(prefix without t) + 1. One pass gives the count of every prefix. Texts fall
into units at spaces, which no piece crosses, and each distinct unit of a worker is solved once.

`prefix_deltas` holds, for each code point of the text, the signed byte by which the count changes
from the prefix before it to the one that ends with it; its running sum answers how many tokens any
cut has and where a budget runs out, without encoding again. Null text: empty, no deltas. Rows are
handled one by one; very long texts stream through bounded slices.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import local_path, slices, texts_of

MODEL = "piece_bpe_32k.model"
#: Units and token pairs that a worker remembers; beyond it the memory is emptied.
REMEMBERED_UNITS, REMEMBERED_PAIRS = 500_000, 400_000
#: Text whose new units are sorted and solved together.
SORTED_BYTES = 8 << 20
_UNIT = re.compile(r" *[^ ]+| +")


class PrefixCounter:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=local_path(path))
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.score = {model.id_to_piece(i).replace("▁", " "): (model.get_score(i), i) for i in plain}
        if any(" " in piece.lstrip(" ") for piece in self.score):
            raise ValueError("a piece crosses a space: texts cannot be cut into units there")
        probe = "a  b　Å "
        if model.decode_pieces(model.encode(probe, out_type=str)) != probe:
            raise ValueError("the model normalizes its input or adds a prefix, which prefix counts don't follow")
        #: Models may put a space before a text that isn't empty.
        self.dummy = model.encode("a", out_type=str)[0].startswith("▁")
        order = sorted(self.score, key=lambda w: (-self.score[w][0], self.score[w][1]))
        self.rank = {w: i for i, w in enumerate(order)}
        #: A piece that merging gives back whole, with the two parts of its last merge.
        self.last_merge: dict[str, tuple[str, str] | None] = {}
        for piece in self.score:
            parts, before = self._merged(piece)
            if len(parts) == 1:
                self.last_merge[piece] = before
        #: The beginnings of pieces; true: such a piece itself.
        self.begins = {w[:i]: False for w in self.score for i in range(1, len(w) + 1)} | {w: w in self.last_merge for w in self.score}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.units: dict[str, tuple[int, bytes]] = {}

    def _merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Plain merging, the best-scored and then leftmost pair first; and the last pair merged."""
        parts, before = list(text), None
        while True:
            found = [(-self.score[w][0], i) for i in range(len(parts) - 1) if (w := parts[i] + parts[i + 1]) in self.score]
            if not found:
                return parts, before
            i = min(found)[1]
            before = (parts[i], parts[i + 1])
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _fit(self, left: str, right: str) -> bool:
        """Whether merging the text of two neighbours gives just these two."""
        key = (left, right)
        fit = self.pairs.get(key)
        if fit is None:
            if len(self.pairs) >= REMEMBERED_PAIRS:
                self.pairs.clear()
            fit = self.pairs[key] = self._merged(left + right)[0] == [left, right] if "  " in left + right else self._apart(left, right)
        return fit

    def _apart(self, left: str, right: str) -> bool:
        """Take the two tokens' merges back, latest first: the tokens stay apart unless the pieces that
        then meet at the border could have merged before the merge that was just taken back."""
        rank, last, limit = self.rank, self.last_merge, 1 << 60
        while True:
            if rank.get(left + right, limit) < limit:
                return False
            a, b = last.get(left), last.get(right)
            if a is None and b is None:
                return True
            # of two merges of one rank the left one came first, so the right one is taken back first
            if b is None or (a is not None and rank[left] > rank[right]):
                limit, left = rank[left], a[1]
            else:
                limit, right = rank[right] + 1, b[0]

    def _learn(self, fresh: list[str]) -> None:
        """Solve units in sorted order; each starts from the prefix it shares with the one before."""
        before, last, count, deltas, alive = "", [""], [0], [], [()]
        begins, score, pairs, units = self.begins, self.score, self.pairs, self.units
        for unit in sorted(fresh):
            shared = 0
            for x, y in zip(before, unit):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], count[shared + 1 :], deltas[shared:], alive[shared + 1 :]
            for end in range(shared + 1, len(unit) + 1):
                on, token = [], ""
                for start in alive[end - 1]:
                    part = unit[start:end]
                    whole = begins.get(part)
                    if whole is not None:
                        on.append(start)
                        if whole and not token:
                            if start:
                                fit = pairs.get((last[start], part))
                                if fit is None:
                                    fit = self._fit(last[start], part)
                                if not fit:
                                    continue
                            token = part
                            n = count[start] + 1
                char = unit[end - 1]
                if char in begins:
                    on.append(end - 1)
                if not token:
                    token = char
                    n = count[end - 1] + (1 if char in score else len(char.encode()))
                deltas.append((n - count[-1]) & 255)
                last.append(token)
                count.append(n)
                alive.append(on)
            before = unit
            units[unit] = n, bytes(deltas)

    def _cut(self, text: str) -> list[str]:
        """Units of a text, before which the model's own space stands if it has one."""
        if not text:
            return []
        text = (" " if self.dummy else "") + text.replace("▁", " ")
        if "  " in text:
            return _UNIT.findall(text)
        first, *rest = text.split(" ")
        rest = list(map(" ".__add__, rest))
        return [first, *rest] if first else rest

    def count(self, texts: list[str]) -> tuple[list[int], list[bytes]]:
        """(tokens, deltas by code point) of each text."""
        cut = list(map(self._cut, texts))
        seen = set().union(*cut)
        fresh = seen - self.units.keys()
        if len(self.units) + len(fresh) > REMEMBERED_UNITS:
            self.units.clear()
            fresh = seen
        self._learn(list(fresh))
        counts, deltas = [], []
        for units in cut:
            found = list(map(self.units.__getitem__, units))
            counts.append(sum([n for n, _ in found]))
            joined = b"".join([d for _, d in found])
            if self.dummy and joined:
                joined = np.frombuffer(joined[:2], np.int8).sum(dtype=np.int8).tobytes() + joined[2:]
            deltas.append(joined)
        return counts, deltas


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def prefix_counts(df: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, prefix_deltas binary) of every row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model)
        for batch in batches:
            for part in slices(batch, most=SORTED_BYTES):
                texts = texts_of(part.column(1))
                n, deltas = c.count(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array(deltas, pa.binary())], [id_col, "n_bytes", "n_tokens", "prefix_deltas"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, prefix_deltas binary")


def _running(deltas: bytes | None) -> np.ndarray:
    return np.cumsum(np.frombuffer(deltas or b"", np.int8), dtype=np.int64)


def tokens_at(deltas: Column, chars: Column) -> Column:
    """Tokens of the prefix of so many code points (beyond the text: of all of it; null counts as 0)."""

    @F.arrow_udf("bigint")
    def at(d: pa.Array, n: pa.Array) -> pa.Array:
        runs = zip(map(_running, d.to_pylist()), n.to_pylist())
        return pa.array([int(run[min(k, len(run)) - 1]) if k and k > 0 and len(run) else 0 for run, k in runs], pa.int64())

    return at(deltas, chars.cast("bigint"))


def chars_within(deltas: Column, budget: Column) -> Column:
    """Code points of the longest prefix that has at most `budget` tokens (null budget: 0)."""

    @F.arrow_udf("bigint")
    def within(d: pa.Array, b: pa.Array) -> pa.Array:
        fits = (np.flatnonzero(_running(x) <= (k or 0)) for x, k in zip(d.to_pylist(), b.to_pylist()))
        return pa.array([int(f[-1]) + 1 if len(f) else 0 for f in fits], pa.int64())

    return within(deltas, budget.cast("bigint"))
