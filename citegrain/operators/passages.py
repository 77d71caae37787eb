"""Passages of texts: as an operator, as a job over pages with very long texts in parts, and as a SQL table function."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..config import DEFAULTS
from ..functions import text as T
from ..sources.ingest import extract_pages
from ..storage import stored

# Separators in the order they are tried.
SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " ")
# What a text is stripped of, the white space of Python.
STRIPPED = "[\\t-\\r\\x1C-\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]+"
#: Texts of more characters are cut into parts that several tasks take, of about TASK_CHARS each.
LONG_CHARS, TASK_CHARS = 100_000, 1_000_000


def _packed(text: str, begin: int, end: int, mark: str, size: int) -> list[tuple[int, int]]:
    """Spans of text[begin:end], cut at `mark`: each takes as many neighbouring parts as fit, or one part that doesn't."""
    starts, ends, at = [begin], [], text.find(mark, begin, end)
    while at >= 0:
        ends.append(at)
        starts.append(at + len(mark))
        at = text.find(mark, starts[-1], end)
    ends.append(end)
    spans, i = [], 0
    while i < len(starts):
        last = max(i, bisect_right(ends, starts[i] + size) - 1)
        if starts[i] < ends[i]:
            spans.append((starts[i], ends[last]))
            i = last
        i += 1
    return spans


def _pieces(text: str, size: int, overlap: int, marks: Sequence[str] = SEPARATORS) -> list[str]:
    """One mark after the other cuts the spans that are still too long, what none cuts is sliced at a fixed stride, and
    then, from the last cut back to the first, each piece of a cut is led by the end of its neighbour."""
    cuts, ready, long = [], [], [(0, len(text))]
    for mark in marks:
        left = []
        for begin, end in long:
            if text.find(mark, begin, end) < 0:
                left.append((begin, end))
                continue
            cuts.append((begin, end))
            for span in _packed(text, begin, end, mark, size):
                (ready if span[1] - span[0] <= size else left).append(span)
        long = left
        if not long:
            break
    step = max(1, size - overlap)
    ready += [(a, min(a + size, end)) for begin, end in long for a in range(begin, end, step)]
    ready.sort()
    words = [text[a:b] for a, b in ready]
    if overlap > 0:
        starts = [a for a, _ in ready]
        for begin, end in reversed(cuts):
            low, high = bisect_left(starts, begin), bisect_left(starts, end)
            words[low + 1 : high] = [f"{words[i - 1][-overlap:]} {words[i]}" for i in range(low + 1, high)]
    return words


def passages(text: str | None, size: int, overlap: int) -> list[str]:
    """Passages of a text: a whole text that fits is one, and of a longer one's pieces those with few characters go."""
    text = (text or "").strip()
    if len(text) <= size:
        return [text] if text else []
    return [w for w in map(str.strip, _pieces(text, size, overlap)) if len(w) > DEFAULTS.min_chunk_chars]


def chunk_text(docs: DataFrame, id_col: str = "doc_id", size: int = DEFAULTS.chunk_size, overlap: int = DEFAULTS.chunk_overlap, text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(id, chunk_no, text, columns of `keep`): passages of whole texts; each starts with the end of the one before.
    Null and blank texts give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [passages(t, size, overlap) for t in batch.column(1).to_pylist()]
            n = [len(m) for m in made]
            rows = pa.array(np.repeat(np.arange(len(n)), n), pa.int64())
            numbers = pa.array([i for k in n for i in range(k)], pa.int32())
            carried = [batch.column(2 + i).take(rows) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), numbers, pa.array([c for m in made for c in m], pa.string()), *carried], [id_col, "chunk_no", "text", *keep])

    schema = StructType([docs.schema[id_col], StructField("chunk_no", IntegerType()), StructField("text", StringType()), *(docs.schema[c] for c in keep)])
    return docs.select(id_col, text_col, *keep).mapInArrow(run, schema)


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, f"^{STRIPPED}|{STRIPPED}$", "")


def chunk_long_texts(docs: DataFrame, id_col: str, size: int, overlap: int, text_col: str, keep: Sequence[str], task_chars: int = TASK_CHARS) -> DataFrame:
    """`chunk_text` for texts longer than `size`: a text is cut at its coarsest separator, tasks take runs of its spans by where
    they stand in it, and overlaps between spans and numbers are put right afterwards."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(0).to_pylist()):
                level = next((k for k, mark in enumerate(SEPARATORS) if mark in text), len(SEPARATORS))
                spans = _packed(text, 0, len(text), SEPARATORS[level], size) if level < len(SEPARATORS) else [(0, len(text))]
                for at in range(0, len(spans), 1024):
                    some = spans[at : at + 1024]
                    same = pa.array([i] * len(some), pa.int64())
                    told = [pa.array(range(at, at + len(some)), pa.int64()), pa.array([a // task_chars for a, _ in some], pa.int64()), pa.array([level] * len(some), pa.int32()), pa.array([text[a:b] for a, b in some], pa.string())]
                    yield pa.RecordBatch.from_arrays([*told, *(c.take(same) for c in batch.columns[1:])], ["_span", "_part", "_level", "_text", *batch.schema.names[1:]])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [SEPARATORS[level + 1 :] for level in batch.column(0).to_pylist()]
            made = [[t] if len(t) <= size else _pieces(t, size, overlap, m) for t, m in zip(batch.column(1).to_pylist(), marks)]
            uncut = pa.array([level == len(SEPARATORS) for level in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.list_(pa.string())), uncut, *batch.columns[2:]], ["_words", "_uncut", *batch.schema.names[2:]])

    own = [docs.schema[id_col], *(docs.schema[c] for c in keep)]
    names = [f.name for f in own]
    rows = docs.select(_stripped(F.col(text_col)).alias("_text"), F.monotonically_increasing_id().alias("_row"), *names).where(F.length("_text") > size)
    spans = stored(rows.mapInArrow(cut, StructType([*StructType.fromDDL("_span bigint, _part bigint, _level int, _text string, _row bigint"), *own])), "spans")
    dealt = spans.repartition("_row", "_part").select("_level", "_text", "_span", "_row", *names)
    words = dealt.mapInArrow(split, StructType([*StructType.fromDDL("_words array<string>, _uncut boolean, _span bigint, _row bigint"), *own]))
    order = Window.partitionBy("_row").orderBy("_span")
    before = F.lag(F.element_at("_words", -1)).over(order)
    w = F.col("_words")  # of a cut, each led by the one before; a text without separators was sliced, not cut
    led = F.transform(w, lambda x, i: F.concat(F.coalesce(F.concat(F.right(F.when(i == 0, F.col("_before")).otherwise(F.get(w, i - 1)), F.lit(overlap)), F.lit(" ")), F.lit("")), x)) if overlap > 0 else w
    told = F.filter(F.transform("_led", _stripped), lambda x: F.length(x) > DEFAULTS.min_chunk_chars)
    top = words.withColumn("_before", before).withColumn("_led", F.when(F.col("_uncut"), w).otherwise(led)).withColumn("_told", told)
    first = F.coalesce(F.sum(F.size("_told")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = top.withColumn("_first", first).select(*names, "_first", F.posexplode("_told").alias("_i", "text"))
    return placed.select(id_col, (F.col("_first") + F.col("_i")).cast("int").alias("chunk_no"), "text", *keep)


def chunk_corpus(docs: DataFrame, id_col: str = "doc_id", size: int = DEFAULTS.chunk_size, overlap: int = DEFAULTS.chunk_overlap, text_col: str = "text", keep: Sequence[str] = (), long_chars: int = LONG_CHARS) -> DataFrame:
    """`chunk_text` for a corpus that holds very long texts, which several tasks take in parts; all others stay where they are."""
    most = max(long_chars, size)
    long = (F.length(text_col) > most) & (F.length(_stripped(F.col(text_col))) > most)
    rest = chunk_text(docs.where(~F.coalesce(long, F.lit(False))), id_col, size, overlap, text_col, keep)
    return rest.unionByName(chunk_long_texts(docs.where(long), id_col, size, overlap, text_col, keep))


def chunk_pages(pages: DataFrame) -> DataFrame:
    """(page_id, chunk_no, text, source_url, source_title, source_domain): passages of raw pages (page_id, url, html), with the page's
    address, the title in its head and its domain."""
    title = F.trim(F.regexp_replace(F.regexp_extract(T.text(F.col("html")), r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
    read = extract_pages(pages.withColumn("source_title", title), keep=("source_title",)).where("text IS NOT NULL")
    told = read.select("page_id", "text", F.col("url").alias("source_url"), "source_title", F.coalesce(T.url_domain(F.col("url")), F.lit("")).alias("source_domain"))
    return chunk_corpus(told, "page_id", keep=("source_url", "source_title", "source_domain"))


class PassageRows:
    """Passages of one text, for lateral joins."""

    def eval(self, text: str | None, size: int, overlap: int) -> Iterator[tuple[int, str]]:
        yield from enumerate(passages(text, size, overlap))


class PassageBatches:
    """Passages of a whole table (id, text), in Arrow batches."""

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        made = [passages(t, DEFAULTS.chunk_size, DEFAULTS.chunk_overlap) for t in rows.column(1).to_pylist()]
        n = [len(m) for m in made]
        ids = rows.column(0).take(pa.array(np.repeat(np.arange(len(n)), n), pa.int64()))
        yield pa.table({"id": ids, "chunk_no": pa.array([i for k in n for i in range(k)], pa.int32()), "passage": pa.array([w for m in made for w in m], pa.string())})


def register_table_functions(spark: SparkSession) -> None:
    """Passages as table functions of SQL: `FROM docs d, LATERAL chunk_passages(d.text, 500, 50)` gives (chunk_no, passage) of
    each row; `FROM chunk_table(TABLE(SELECT id, text FROM docs))` gives (id, chunk_no, passage) of a whole table with bigint ids
    in Arrow batches, which Spark doesn't allow in a lateral join."""
    spark.udtf.register("chunk_passages", F.udtf(PassageRows, returnType="chunk_no int, passage string"))
    spark.udtf.register("chunk_table", F.arrow_udtf(PassageBatches, returnType="id bigint, chunk_no int, passage string"))
