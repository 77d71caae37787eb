"""Periodic run detection: maximal stretches of words that repeat with a small enough period.

A run has smallest period q, at least `LEAST` words and four periods, and no neighbouring word extends it.
Short periods (up to `LAGS`) come from direct scans at each lag. Longer ones come from minimizers at scales
that double: at scale s, for periods in (s/2, s], the word s-grams are hashed, and a position counts that holds
the least hash of a window of s/2 s-grams. An s-gram can't recur within less than a period q <= s of its run
(the run would have a smaller period), so two windows of the run that are a period apart have their minima at
exactly that distance, with no equal s-gram between: neighbouring equal minima seed the extension, which
compares words, so that results don't rest on hashes but for s-grams of the same run that share 64 bits.

The texts of a slice are searched together, parted by words of their own, longest first, so that a scale
only touches texts long enough for it.

Null and empty texts and texts without runs have none and keep their words. Very long texts are searched whole,
one after another; a text's memory is some numbers a word, and each different word once. Repeated rows
have equal results, an empty table gives no rows, and further columns stay out of the way.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .common import slices, texts_of

LEAST, PERIODS = 6, 4
#: Periods up to this are scanned directly; a power of two.
LAGS = 16
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def spread(x: np.ndarray) -> np.ndarray:
    """Mix 64-bit numbers so that equal ones stay equal and others look random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sliding(f, x: np.ndarray, width: int) -> np.ndarray:
    """f (minimum or maximum) over each window of `width`, a power of two."""
    step = 1
    while step < width:
        x = f(x[:-step], x[step:])
        step *= 2
    return x


def minimizers(h: np.ndarray, width: int) -> np.ndarray:
    """Positions that hold the least hash of some window of `width`."""
    least = sliding(np.minimum, h, width)
    edge = np.zeros(width - 1, np.uint64)
    return np.flatnonzero(sliding(np.maximum, np.concatenate([edge, least, edge]), width) == h)


def equal_ahead(words: np.ndarray, at: int, lag: int) -> int:
    """First position from `at` whose word differs from the one `lag` further on."""
    end, block = len(words) - lag, 64
    while at < end:
        stop = min(end, at + block)
        differs = words[at:stop] != words[at + lag : stop + lag]
        first = int(differs.argmax())
        if differs[first]:
            return at + first
        at, block = stop, min(block * 2, 1 << 16)
    return end


def equal_behind(words: np.ndarray, at: int, lag: int) -> int:
    """Smallest position from which on all words up to `at` equal those `lag` further on."""
    block = 64
    while at > 0:
        stop = max(0, at - block)
        differs = words[stop:at] != words[stop + lag : at + lag]
        if differs.any():
            return at - int(differs[::-1].argmax())
        at, block = stop, min(block * 2, 1 << 16)
    return 0


def runs_of(words: np.ndarray, longest: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in numbered words. `longest` has the lengths of its texts in falling
    order; texts are parted by words that occur once."""
    found: dict[tuple[int, int], int] = {}  # the smallest period of each stretch

    def tell(start: int, end: int, lag: int) -> None:
        if end - start >= max(LEAST, PERIODS * lag) and found.get((start, end), lag + 1) > lag:
            found[start, end] = lag

    for lag in range(1, LAGS + 1):
        if len(words) <= lag:
            break
        same = np.zeros(len(words) - lag + 2, np.int8)
        same[1:-1] = words[lag:] == words[:-lag]
        change = np.diff(same)
        starts, stops = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        long = stops - starts >= max(LEAST, PERIODS * lag) - lag
        for start, stop in zip(starts[long].tolist(), stops[long].tolist()):
            tell(start, stop + lag, lag)
    size, h = 1, spread(words.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    ends = np.cumsum([0, *(n + 1 for n in longest)])
    lengths = np.array(longest)
    while True:
        width = size  # half of the scale
        if width >= LAGS:
            texts = int(np.searchsorted(-lengths, -PERIODS * (width + 1), side="right"))
            if not texts:
                break
            h = h[: ends[texts]]
        if len(h) <= size:
            break
        h = spread(h[:-size] * np.uint64(0x9E3779B97F4A7C15) + (h[size:] ^ (h[size:] >> np.uint64(32))))
        size *= 2
        if width < LAGS or len(h) < width:
            continue
        at = minimizers(h, width)
        order = np.argsort(h[at], kind="stable")
        at = at[order]
        lag = np.diff(at)
        seeds = (h[at[1:]] == h[at[:-1]]) & (lag > width) & (lag <= size)
        covered: dict[int, int] = {}  # by lag: up to where the text was extended
        for m, d in sorted(zip(at[:-1][seeds].tolist(), lag[seeds].tolist())):
            if covered.get(d, -1) > m:
                continue
            stop = equal_ahead(words, m, d)
            covered[d] = stop
            if stop > m:
                tell(equal_behind(words, m, d), stop + d, d)
    return [(start, end - start, lag) for (start, end), lag in found.items()]


def numbered(texts: list[str]) -> tuple[list[str], list[np.ndarray]]:
    """(words by number, the numbers of each text's words)."""
    number: dict[str, int] = {}
    told = []
    for text in texts:
        ids = array("i")
        for word in _WORD.finditer(text):
            ids.append(number.setdefault(word.group(), len(number)))
        told.append(np.frombuffer(ids, np.int32) if ids else np.empty(0, np.int32))
    return list(number), told


def collapse(texts: list[str]) -> list[tuple[list[tuple[int, int, int]], str]]:
    """For each text its runs by start and period, and its words without those behind the first period of a run."""
    names, told = numbered(texts)
    order = sorted(range(len(texts)), key=lambda i: -len(told[i]))
    lengths = [len(told[i]) for i in order]
    begins = np.cumsum([0, *(n + 1 for n in lengths)])
    words = np.empty(int(begins[-1]), np.int64)
    for place, i in enumerate(order):
        words[begins[place] : begins[place] + lengths[place]] = told[i]
        words[begins[place] + lengths[place]] = len(names) + place  # a word of its own
    by_text: dict[int, list] = {}
    for start, length, period in sorted(runs_of(words, lengths), key=lambda r: (r[0], r[2])):
        place = int(np.searchsorted(begins, start, side="right")) - 1
        by_text.setdefault(order[place], []).append((start - int(begins[place]), length, period))
    done = []
    for i, ids in enumerate(told):
        runs = by_text.get(i, [])
        kept = np.ones(len(ids), bool)
        for start, length, period in runs:
            kept[start + period : start + length] = False
        done.append((runs, " ".join(names[k] for k in ids[kept].tolist())))
    return done


def periodic_runs(df: DataFrame, text_col: str = "text") -> DataFrame:
    """`df` with `runs` (start, length, period; by start, then period) and `collapsed`, the kept words joined by one space;
    columns of `df` that have these names give way."""
    others = [c for c in df.columns if c not in ("runs", "collapsed")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column=0):
                done = collapse(texts_of(part.column(0)))
                runs = pa.array([[dict(zip(("start", "length", "period"), r)) for r in told] for told, _ in done], RUNS)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], runs, pa.array([text for _, text in done], pa.string())], [*others, "runs", "collapsed"])

    made = StructType.fromDDL("runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    schema = StructType([*df.select(*others).schema, *made])
    return df.select(df[text_col].alias("_searched"), *others).mapInArrow(run, schema)
