"""Removal of repeated passages by prefix-free parsing.

Every byte covered by a string of `size` bytes that also starts somewhere else goes, within and across
documents. Rolling-hash triggers cut the texts into phrases so that equal strings are cut alike; a
trigger with the windows that it governs is one entry of the parse. An entry's left context is what
stands between its first window and the trigger, its right one the bytes from the trigger on.

1. Dictionary: entries are counted by content. Content that occurs twice settles all its windows at once,
   which is what makes highly repetitive text cheap; an entry whose core (the bytes all its windows share)
   occurs once can't hold a repeated window and is done.
2. Corpus order: of the contents left, one occurrence of each is sorted by core and by the suffix from the
   trigger on; in that order the suffixes are compared byte by byte with their neighbours, and so are the
   left contexts, backwards. With p bytes alike on the right and s on the left, the windows that start
   size - p to s bytes before the trigger are equal. The order of PAIRED contents at most is followed.
3. A core of more contents, such as a passage that many documents share with other text beside it, is split
   by finer keys, as prefix doubling refines a suffix order: blocks of windows by shared core, then single
   windows in blocks that hold both repeated and other ones. These are counted, so no group meets in a task.
4. Windows found are joined to their documents as spans.

Contents, blocks and windows are known by two 64-bit digests: of the core and of the whole. Null and short
texts keep all their bytes. Repeated rows are each other's copies. Very long texts are parsed in
overlapping segments.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices
from .phrases import mix, triggers

#: A trigger is sought among so many positions; windows of a block; bytes parsed at a time; contents of a core in order.
REACH, BLOCK, SEGMENT, PAIRED = 256, 16, 1 << 20, 64
ROW = ("id", "th")
NO_ID = -(1 << 63)


def _digests(data: bytes, spans: Iterator[tuple[int, int, int]]) -> np.ndarray:
    """Signed 64-bit digests of data[start:end] with a seed."""
    whole, digest = memoryview(data), xxhash.xxh3_64_intdigest
    return np.array([digest(whole[a:b], seed) for a, b, seed in spans], np.uint64).view(np.int64)


def _arrow(df: DataFrame, f: Callable[[list], list], schema: str, heavy: int, kept: int) -> DataFrame:
    """mapInArrow where `f` makes columns out of each row's values, with the first `kept` columns repeated."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column=heavy, most=2 << 20):
                rows = zip(*(c.to_pylist() for c in part.columns))
                made = [(row[:kept], out) for row in rows if len((out := f(list(row)))[0])]
                if made:
                    n = [len(out[0]) for _, out in made]
                    columns = [pa.array(np.repeat(np.array([row[i] for row, _ in made], np.int64), n)) for i in range(kept)]
                    for i in range(len(names) - kept):
                        if isinstance(made[0][1][i], list):
                            columns.append(pa.array([x for _, out in made for x in out[i]], pa.binary()))
                        else:
                            columns.append(pa.array(np.concatenate([out[i] for _, out in made])))
                    yield pa.RecordBatch.from_arrays(columns, names)

    return df.mapInArrow(run, schema)


def _stretches(texts: list[str | None], size: int, segment: int) -> Iterator[tuple[list[int], list[int], bytes, list[int]]]:
    """(row, offset in the row's text, all bytes, ends in them) of texts and segments of long texts, some at a time."""
    rows, offsets, held, ends, total = [], [], [], [], 0
    for row, text in enumerate(texts):
        raw = (text or "").encode()
        for start in range(0, max(1, len(raw) - size + 1), segment):
            piece = raw[start : start + segment + size - 1]
            if len(piece) < size:
                continue
            if total and total + len(piece) > 2 * segment:
                yield rows, offsets, b"".join(held), ends
                rows, offsets, held, ends, total = [], [], [], [], 0
            total += len(piece)
            rows.append(row)
            offsets.append(start)
            held.append(piece)
            ends.append(total)
    if rows:
        yield rows, offsets, b"".join(held), ends


PARSE = [*ROW, "core", "content", "first", "last", "trigger", "known"]


def _parse(docs: DataFrame, size: int, segment: int) -> DataFrame:
    """Entries (id, th, core, content, first window, last window, trigger, known) of documents (id, th, text). Of the
    entries of one content that a task parses together, all after the second are known to be repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column=2, most=SEGMENT):
                ids, hashes = (part.column(i).to_numpy() for i in (0, 1))
                for rows, offsets, data, ends in _stretches(part.column(2).to_pylist(), size, segment):
                    ends = np.array(ends)
                    starts = np.concatenate([[0], ends[:-1]])
                    trigger, first, last = triggers(data, starts, ends, size, REACH)
                    t, a, b = trigger.tolist(), first.tolist(), last.tolist()
                    core = _digests(data, ((x, x + size - REACH + 1, 0) for x in t))
                    content = _digests(data, ((y, z + size, (x - y) << 32 | (x - z)) for x, y, z in zip(t, a, b)))
                    both = core.view(np.uint64) ^ mix(content.view(np.uint64))
                    order = np.argsort(both, kind="stable")
                    ordered = both[order]
                    known = np.zeros(len(order), bool)
                    known[order[2:]] = ordered[2:] == ordered[:-2]
                    of = np.searchsorted(ends, first, "right")
                    row, move = np.array(rows)[of], (np.array(offsets) - starts)[of]
                    columns = [ids[row], hashes[row], core, content, first + move, last + move, trigger + move, known]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], PARSE)

    schema = ", ".join(f"{c} bigint" for c in PARSE[:-1]) + ", known boolean"
    return docs.select(*ROW, "text").mapInArrow(run, schema)


def _shared_cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of entries in the order of their cores, those whose core several have, as they stream by."""
    held, joined = None, False  # the last row, which the next one decides on
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
        core = rows.column(2).to_numpy()
        alike = core[1:] == core[:-1]
        on = np.concatenate([[joined], alike]) | np.concatenate([alike, [False]])
        yield rows.slice(0, len(on) - 1).filter(pa.array(on[:-1]))
        held, joined = rows.slice(len(on) - 1), bool(on[-1])
    if joined:
        yield held


def _contexts(packed: bytes, entries: list[dict], size: int) -> list:
    """(core, first, last, trigger, n, contents, left context, right context) of given entries of a text."""
    raw = zstandard.ZstdDecompressor().decompress(packed)
    columns = [np.array([e[k] for e in entries], np.int64) for k in ("core", "first", "last", "trigger", "n", "contents")]
    left = [raw[e["first"] : e["trigger"]] for e in entries]
    return [*columns, left, [raw[e["trigger"] : e["last"] + size] for e in entries]]


def _padded(column: pa.Array, width: int, backwards: bool) -> tuple[np.ndarray, np.ndarray]:
    """(matrix of the strings' first `width` bytes, or their last ones from the end back; lengths)."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"\0", np.uint8)
    lengths = np.diff(offsets)
    at = offsets[1:, None] - 1 - np.arange(width) if backwards else offsets[:-1, None] + np.arange(width)
    return data[np.clip(at, 0, max(0, len(data) - 1))], lengths


def _alike(m: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many first bytes the rows a and b of a matrix have in common."""
    differ = m[a] != m[b]
    n = np.where(differ.any(1), differ.argmax(1), m.shape[1])
    return np.minimum(n, np.minimum(lengths[a], lengths[b]))


def _in_order(size: int, paired: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Repeated windows (id, th, first, last) of contents (id, th, core, trigger, n, left, right) that stream by in the
    order of core and right context; of those that occur more than once, which are settled, nothing is told."""

    def solved(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        core, trigger, n = (rows.column(i).to_numpy() for i in (2, 3, 4))
        right, n_right = _padded(rows.column(6), size, False)
        left, n_left = _padded(rows.column(5), REACH, True)
        found = []
        for apart in range(1, paired):
            a = np.flatnonzero(core[apart:] == core[:-apart])
            if not len(a):
                break
            b = a + apart
            p = _alike(right, n_right, a, b)
            near = p > size - REACH
            a, b, p = a[near], b[near], p[near]
            s = _alike(left, n_left, a, b)
            on = s + p >= size
            for x in (a[on], b[on]):
                found.append(np.stack([x, trigger[x] - s[on], trigger[x] - size + p[on]])[:, n[x] == 1])
        if found:
            at, first, last = np.unique(np.concatenate(found, 1), axis=1)
            columns = [rows.column(0).take(pa.array(at)), rows.column(1).take(pa.array(at)), pa.array(first), pa.array(last)]
            yield pa.RecordBatch.from_arrays(columns, [*ROW, "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for part in slices(batch, column=6, most=2 << 20):
                rows = pa.Table.from_batches([part] if held is None else [held, part]).combine_chunks().to_batches()[0]
                core = rows.column(2).to_numpy()
                whole = int(np.searchsorted(core, core[-1]))  # the last core may go on
                if whole:
                    yield from solved(rows.slice(0, whole))
                held = rows.slice(whole)
        if held is not None:
            yield from solved(held)

    return run


def _blocks(row: list, size: int) -> list[np.ndarray]:
    """(core, first window of the entry, first and last of a block, class, content) of blocks of windows; blocks are
    cut at multiples of BLOCK from the trigger backwards, so entries of one core have them alike."""
    core, first, last, trigger, data = row
    ahead = trigger - np.arange(first, last + 1)  # of each window
    begins = np.flatnonzero(np.concatenate([[True], ahead[1:] // BLOCK != ahead[:-1] // BLOCK]))
    ends = np.concatenate([begins[1:] - 1, [len(ahead) - 1]])
    lead, block = trigger - first, ahead[begins] // BLOCK
    # the bytes that all windows of a whole block share; an entry that has one of them has these too
    shared = _digests(data, ((lead - k * BLOCK, lead - k * BLOCK - BLOCK + 1 + size, k) for k in block.tolist()))
    shapes = zip(begins.tolist(), ends.tolist(), ahead[begins].tolist(), ahead[ends].tolist())
    content = _digests(data, ((a, b + size, x << 32 | y) for a, b, x, y in shapes))
    n = len(begins)
    return [np.full(n, core), np.full(n, first), first + begins, first + ends, shared, content]


def _windows(row: list, size: int) -> list[np.ndarray]:
    """(core, first window of the entry, window, class) of the windows of given blocks."""
    core, first, trigger, data, runs = row
    at = np.concatenate([np.arange(x["from"], x["to"] + 1) for x in runs])
    window = _digests(data, ((i - first, i - first + size, trigger - i) for i in at.tolist()))
    return [np.full(len(at), core), np.full(len(at), first), at, window]


def _split(many: DataFrame, size: int) -> DataFrame:
    """Repeated windows (id, th, first, last) of contents (id, th, core, first, last, trigger, n, data) whose cores have
    too many of them to be followed in order."""
    schema = "id bigint, th bigint, core bigint, first bigint, from bigint, to bigint, class bigint, content bigint"
    rows = many.select(*ROW, "core", "first", "last", "trigger", "data")
    blocks = materialize(_arrow(rows, lambda r: _blocks(r[2:], size), schema, 6, 2), "blocks")
    classes = blocks.groupBy("core", "class").agg(F.count(F.lit(1)).alias("n"), F.min("content").alias("low"), F.max("content").alias("top")).where("n > 1")
    met = blocks.join(classes, ["core", "class"]).select(*ROW, "core", "first", "from", "to", (F.col("low") == F.col("top")).alias("alike"))
    met = materialize(met, "met")
    uneven = met.where("not alike").groupBy(*ROW, "first", "core").agg(F.collect_list(F.struct("from", "to")).alias("runs"))
    rows = many.join(uneven, [*ROW, "first", "core"]).select(*ROW, "core", "first", "trigger", "data", "runs")
    schema = "id bigint, th bigint, core bigint, first bigint, at bigint, class bigint"
    windows = materialize(_arrow(rows, lambda r: _windows(r[2:], size), schema, 5, 2), "windows")
    twice = windows.groupBy("core", "class").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core", "class")
    single = windows.join(twice, ["core", "class"]).select(*ROW, "first", F.col("at").alias("from"), F.col("at").alias("to"))
    found = met.where("alike").select(*ROW, "first", "from", "to").unionAll(single)
    # contents that occur more than once are settled whole and only stood by as partners
    found = found.join(many.where("n = 1").select(*ROW, "first"), [*ROW, "first"])
    return found.select(*ROW, F.col("from").alias("first"), F.col("to").alias("last"))


def repeated_spans(docs: DataFrame, size: int = 400, segment: int = SEGMENT, paired: int = PAIRED) -> DataFrame:
    """(id, th, first, last): runs of repeated windows of documents (id, th, text)."""
    parse = materialize(_parse(docs, size, segment), "parse")
    entries = parse.where("not known").drop("known")
    entries = entries.repartition("core").sortWithinPartitions("core").mapInArrow(_shared_cores, entries.schema)
    entries = materialize(entries, "entries")
    at = F.min(F.struct(*ROW, "first", "last", "trigger")).alias("at")
    counted = materialize(entries.groupBy("core", "content").agg(F.count(F.lit(1)).alias("n"), at), "contents")
    settled = entries.join(counted.where("n > 1").select("core", "content"), ["core", "content"]).select(*ROW, "first", "last")
    settled = settled.unionAll(parse.where("known").select(*ROW, "first", "last"))
    # where contents differ: one occurrence of each stands for all; those that occur once are open
    cores = counted.groupBy("core").agg(F.count(F.lit(1)).alias("contents"), F.min("n").alias("least")).where("contents > 1 AND least = 1")
    open_ = counted.join(cores.select("core", "contents"), "core").select("core", "contents", "n", "at.*")
    per_doc = open_.groupBy(*ROW).agg(F.collect_list(F.struct("core", "first", "last", "trigger", "n", "contents")).alias("entries"))
    texts = packed_rows(docs).join(per_doc, list(ROW)).select(*ROW, "packed", "entries")
    schema = ", ".join(f"{c} bigint" for c in (*ROW, "core", "first", "last", "trigger", "n", "contents"))
    kept = _arrow(texts, lambda r: _contexts(r[2], r[3], size), f"{schema}, left binary, right binary", 2, 2)
    kept = materialize(kept, "contexts")
    few = kept.where(F.col("contents") <= paired).select(*ROW, "core", "trigger", "n", "left", "right")
    few = few.repartition("core").sortWithinPartitions("core", "right")
    few = few.mapInArrow(_in_order(size, paired), "id bigint, th bigint, first bigint, last bigint")
    many = kept.where(F.col("contents") > paired).select(*ROW, "core", "first", "last", "trigger", "n", F.concat("left", "right").alias("data"))
    return settled.unionAll(few).unionAll(_split(many, size))


def packed_rows(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            data = [pack.compress((t or "").encode()) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary())], [*ROW, "packed"])

    return docs.select(*ROW, "text").mapInArrow(run, "id bigint, th bigint, packed binary")


def covered(spans: list[dict] | None, n: int, size: int) -> np.ndarray:
    """Which bytes the windows cover."""
    edge = np.zeros(n + 1, np.int64)
    if spans:
        np.add.at(edge, [s["first"] for s in spans], 1)
        np.add.at(edge, [s["last"] + size for s in spans], -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(
    df: DataFrame, size: int = 400, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT, paired: int = PAIRED
) -> DataFrame:
    """(doc_id, n_bytes, removed array of (start, end), kept binary) for every row. `size` is more than REACH + 16
    bytes; `segment` and `paired` decide memory and work, never results."""
    id_ = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id")
    docs = df.select(id_, F.xxhash64(text_col).alias("th"), F.col(text_col).cast("string").alias("text"))
    spans = repeated_spans(docs, size, segment, paired).groupBy(*ROW).agg(F.collect_set(F.struct("first", "last")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for part in slices(batch, column=1, most=1 << 20):
                n, removed, kept = [], [], []
                for packed, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    raw = unpack.decompress(packed)
                    n.append(len(raw))
                    if not found:
                        removed.append([])
                        kept.append(raw)
                        continue
                    gone = covered(found, len(raw), size)
                    change = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                    removed.append([{"start": int(a), "end": int(b)} for a, b in zip(change[::2], change[1::2])])
                    kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
                ids = pa.array([None if i == NO_ID else i for i in part.column(0).to_pylist()], pa.int64())
                spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                columns = [ids, pa.array(n, pa.int64()), pa.array(removed, spans_type), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "removed", "kept"])

    joined = packed_rows(docs).join(spans, list(ROW), "left").select("id", "packed", "spans")
    return joined.mapInArrow(run, "doc_id bigint, n_bytes bigint, removed array<struct<start:bigint,end:bigint>>, kept binary")
