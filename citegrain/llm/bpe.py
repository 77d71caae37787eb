"""Byte-level BPE over whole documents.

Texts are cut into units at single spaces (a cut the pre-tokenizer always makes), each distinct unit
of a worker is encoded once, and the distinct words are merged together in length-bucketed padded
matrices: in every round each row merges its leftmost pair of minimum rank, ranks come from a hashed
pair table, finished rows leave the matrix and the consumed columns are compacted away.

Null texts count as empty, empty texts have no ids; very long words get a matrix of their own width.
Rows are handled one by one, so repeated rows give repeated results, and other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from base64 import b64decode
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import give_back, local_path, slices, texts_of

RANKS = "byte_bpe_50k.tiktoken"
NONE = np.int32(2**31 - 1)
#: Units that a worker remembers; beyond it the memory is emptied and filled anew.
REMEMBERED_UNITS = 300_000
#: Cells of a matrix.
MATRIX_CELLS = 1 << 20
#: Ids decoded at a time.
DECODED_IDS = 1 << 20


class PairTable:
    """Open-addressing hash table from a pair of ids to the rank of their concatenation."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        keys = np.fromiter(pairs, np.uint64, len(pairs))
        values = np.fromiter(pairs.values(), np.int32, len(pairs))
        bits = max(4, int(2 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.values = np.full(1 << bits, ~np.uint64(0)), np.full(1 << bits, NONE)
        slot, rows = self._slot(keys), np.arange(len(keys))
        while len(rows):
            at = slot[rows]
            free = self.keys[at] == ~np.uint64(0)
            _, first = np.unique(at[free], return_index=True)
            won = rows[free][first]
            self.keys[slot[won]], self.values[slot[won]] = keys[won], values[won]
            rows = np.setdiff1d(rows, won, assume_unique=True)
            slot[rows] = (slot[rows] + (self.keys[slot[rows]] != ~np.uint64(0))) & self.mask
        #: Ids that some neighbour can turn into an id no higher. A merge into any other id makes only
        #: pairs of higher rank, so all disjoint occurrences of a row's minimum pair merge in one
        #: round and in the order that one by one would give.
        self.single = np.zeros(max(ranks.values()) + 1, bool)
        for part in ((keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)):
            self.single[part[values <= part]] = True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NONE where the pair doesn't merge or a side is padding (-1)."""
        out = np.full(left.shape, NONE)
        real = np.flatnonzero((left >= 0) & (right >= 0))
        keys = left.ravel()[real].astype(np.uint64) << np.uint64(32) | right.ravel()[real].astype(np.uint64)
        slot, flat = self._slot(keys), out.ravel()
        while len(real):
            found = self.keys[slot]
            hit = found == keys
            flat[real[hit]] = self.values[slot[hit]]
            on = ~hit & (found != ~np.uint64(0))
            real, keys, slot = real[on], keys[on], (slot[on] + 1) & self.mask
        return flat.reshape(left.shape)


def _disjoint(same: np.ndarray) -> np.ndarray:
    """Of runs of adjacent occurrences, every second one from the left."""
    columns = np.arange(same.shape[1])
    before = np.maximum.accumulate(np.where(same, -1, columns), axis=1)
    return same & ((columns - before) % 2 == 1)


def _compacted(matrix: np.ndarray, rows: np.ndarray, columns: np.ndarray, to: np.ndarray, width: int, fill: int) -> np.ndarray:
    out = np.full(len(matrix) * width, fill, matrix.dtype)
    out[to] = matrix[rows, columns]
    return out.reshape(len(matrix), width)


def gather(starts: np.ndarray, counts: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The concatenation of flat[start : start + count]."""
    ends = np.cumsum(counts)
    return flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + counts, counts)]


def merge_rows(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, byte_ids: np.ndarray, pairs: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """(counts, ids) of words of similar lengths, given as bytes raw[start : start + length]: one padded matrix."""
    width = max(2, int(lengths.max()))
    ids = np.full((len(lengths), width), -1, np.int32)
    ids[np.arange(width) < lengths[:, None]] = byte_ids[gather(starts, lengths, raw)]
    rank = np.full(ids.shape, NONE)
    rank[:, :-1] = pairs.rank(ids[:, :-1], ids[:, 1:])
    row, ended = np.arange(len(lengths)), []
    while len(row):
        lowest = rank.min(axis=1)
        done = lowest == NONE
        if done.any():
            real = ids[done] >= 0
            ended.append((row[done], real.sum(axis=1), ids[done][real]))
            ids, rank, row, lowest = ids[~done], rank[~done], row[~done], lowest[~done]
            if not len(row):
                break
        chosen = _disjoint(rank == lowest[:, None])
        single = np.flatnonzero(pairs.single[lowest])
        if len(single):
            first = rank[single].argmin(axis=1)
            chosen[single] = False
            chosen[single, first] = True
        ids = np.where(chosen, lowest[:, None], ids)
        keep = ids >= 0
        keep[:, 1:] &= ~chosen[:, :-1]
        place = np.cumsum(keep, axis=1) - 1
        width = max(2, int(place[:, -1].max()) + 1)
        rows, columns = np.nonzero(keep)
        to = rows * width + place[rows, columns]
        ids, rank, fresh = (_compacted(m, rows, columns, to, width, fill) for m, fill in ((ids, -1), (rank, NONE), (chosen, False)))
        fresh[:, :-1] |= fresh[:, 1:].copy()
        fresh[:, -1] = False
        rank[:, -1] = NONE
        rows, columns = np.nonzero(fresh)
        rank[rows, columns] = pairs.rank(ids[rows, columns], ids[rows, columns + 1])
    row, n, flat = (np.concatenate(x) for x in zip(*ended))
    counts = np.empty(len(lengths), np.int64)
    counts[row] = n
    order = np.argsort(row)
    return counts, gather((np.cumsum(n) - n)[order], n[order], flat)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(local_path(path), "rb") as file:
        return {b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


@lru_cache(maxsize=2)
def vocabulary(path: str) -> np.ndarray:
    """Tokens by id; ids that stand for none are empty."""
    ranks = read_ranks(path)
    tokens = np.full(max(ranks.values()) + 1, b"", object)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


class Encoder:
    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs = PairTable(self.ranks)
        self.pattern = regex.compile(pattern)
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.starts, self.counts = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(counts, ids) of distinct pre-tokens."""
        raw = [w.encode() for w in words]
        whole = np.fromiter((self.ranks.get(r, -1) for r in raw), np.int32, len(raw))
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        starts, joined = np.cumsum(lengths) - lengths, np.frombuffer(b"".join(raw), np.uint8)
        hit = np.flatnonzero(whole >= 0)
        rest = np.flatnonzero(whole < 0)
        rest = rest[np.argsort(lengths[rest], kind="stable")]
        found = [(hit, np.ones(len(hit), np.int64), whole[hit])]
        while len(rest):
            # buckets four to an octave, so that little of a matrix is padding
            step = 1 << max(0, int(lengths[rest[0]]).bit_length() - 3)
            bucket = (int(lengths[rest[0]]) + step - 1) // step * step
            n = min(max(1, MATRIX_CELLS // bucket), int(np.searchsorted(lengths[rest], bucket, "right")))
            found.append((rest[:n], *merge_rows(joined, starts[rest[:n]], lengths[rest[:n]], self.byte_ids, self.pairs)))
            rest = rest[n:]
        row, n, flat = (np.concatenate(x) for x in zip(*found))
        counts = np.empty(len(words), np.int64)
        counts[row] = n
        order = np.argsort(row)
        return counts, gather((np.cumsum(n) - n)[order], n[order], flat)

    def units(self, text: str) -> list[str]:
        """Cut before each space that is followed by no space; texts with runs of white space after
        a space are left whole."""
        if not text:
            return []
        if _RUN.search(text):
            return [text]
        first, *rest = text.split(" ")
        rest = list(map(" ".__add__, rest))
        return [first, *rest] if first else rest

    def _learn(self, fresh: list[str]) -> None:
        cut = list(map(self.pattern.findall, fresh))
        n = np.fromiter(map(len, cut), np.int64, len(cut))
        words = list(dict.fromkeys(chain.from_iterable(cut)))
        place = dict(zip(words, range(len(words))))
        counts, flat = self.encode_words(words)
        at = np.fromiter(map(place.__getitem__, chain.from_iterable(cut)), np.int64, int(n.sum()))
        sizes = np.diff(np.concatenate([[0], np.cumsum(counts[at])])[np.concatenate([[0], np.cumsum(n)])])
        base = len(self.flat)
        self.index.update(zip(fresh, range(len(self.counts), len(self.counts) + len(fresh))))
        self.starts = np.concatenate([self.starts, base + np.cumsum(sizes) - sizes])
        self.counts = np.concatenate([self.counts, sizes])
        self.flat = np.concatenate([self.flat, gather((np.cumsum(counts) - counts)[at], counts[at], flat)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of all texts."""
        cut = [self.units(t) for t in texts]
        seen = set().union(*cut) if cut else set()
        fresh = seen - self.index.keys()
        if len(self.index) + len(fresh) > REMEMBERED_UNITS and self.index:
            self.forget()
            fresh = seen
        if fresh:
            self._learn(list(fresh))
        n = [len(u) for u in cut]
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(cut)), np.int64, sum(n))
        counts = self.counts[at]
        offsets = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(n)])]
        return offsets.astype(np.int32), gather(self.starts[at], counts, self.flat)


_RUN = re.compile(r" (?=\s)")


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _encoding(ranks: str, pattern: str, id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks, pattern)
        for batch in batches:
            for part in slices(batch, most=1 << 20):
                offsets, ids = enc.encode(texts_of(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], [id_col, "ids"])
        enc.forget()
        give_back()

    return run


def bpe_encode(df: DataFrame, ranks: str = RANKS, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): the ids of every whole text. Null text: empty; null id: kept."""
    kind = df.schema[id_col].dataType.simpleString()
    run = _encoding(ranks, pattern or default_pattern(), id_col)
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def _some_ids(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows of (id, ids) with DECODED_IDS ids at about, one row at least."""
    ends, start = batch.column(1).offsets.to_numpy(), 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + DECODED_IDS, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def _decoding(ranks: str, id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary(ranks)
        for batch in batches:
            for part in _some_ids(batch):
                rows = part.column(1)
                flat, ends = rows.values.to_numpy(), rows.offsets.to_numpy()
                decoded = [b"".join(tokens[flat[a:b]].tolist()) for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), rows, pa.array(decoded, pa.binary())], [id_col, "ids", "decoded"])

    return run


def bpe_decode(df: DataFrame, ranks: str = RANKS, id_col: str = "doc_id") -> DataFrame:
    """(id, ids, decoded binary): the bytes that each row's ids stand for. Null ids: no bytes."""
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, "ids").mapInArrow(_decoding(ranks, id_col), f"`{id_col}` {kind}, ids array<int>, decoded binary")


def bpe_round_trip(df: DataFrame, ranks: str = RANKS, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """bpe_decode(bpe_encode(df)) by one worker a task, a slice at a time, where two would pass the ids on."""
    encode, decode = _encoding(ranks, pattern or default_pattern(), id_col), _decoding(ranks, id_col)
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(lambda batches: decode(encode(batches)), f"`{id_col}` {kind}, ids array<int>, decoded binary")


def id_digest(df: DataFrame, ranks: str = RANKS, pattern: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) from (id, ids): decodes the ids inside the task."""
    pattern = pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary(ranks)
        words = np.array([b"%d " % i for i in range(len(tokens))], object)
        for batch in batches:
            rows = batch.column(1)
            flat, ends = rows.values.to_numpy(), rows.offsets.to_numpy()
            n, told, decoded = [], [], []
            for a, b in zip(ends[:-1], ends[1:]):
                ids = flat[a:b]
                n.append(len(ids))
                told.append(hashlib.sha256(b"".join(words[ids].tolist())[:-1]).hexdigest())
                decoded.append(hashlib.sha256(b"".join(tokens[ids].tolist())).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(told, pa.string()), pa.array(decoded, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
