"""Bounded samples of labelled documents, and scores by a model that each worker keeps."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEPT, give_back, slices

#: Text that training takes at most, in characters.
TRAIN_CHARS = 48_000_000


def residue(divisor: int, id_col: str = "doc_id"):
    """crc32 of the id as text, modulo the divisor; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % divisor


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, allowed, most_docs: int, most_chars: int = TRAIN_CHARS) -> tuple[list[str | None], np.ndarray]:
    """(texts, labels): of the rows of `labels` that `allowed` admits and that have a label, the first
    `most_docs` by a hash of their ids, without the rows that `most_chars` has no room for beside those
    before them."""
    order = F.xxhash64(F.lit("sample"), "doc_id")
    known = labels.where(allowed & F.col(label).isNotNull()).select("doc_id", F.col(label).cast("double").alias("y")).distinct()
    # sorting on all columns also breaks ties; the sample is small by its bound, so it can be broadcast
    chosen = known.orderBy(order, "doc_id", "y").limit(most_docs)
    texts, y = row_sample(documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "y", most_docs, most_chars)
    return texts, np.array(y, float)


def row_sample(rows: DataFrame, label: str, most_docs: int, most_chars: int = TRAIN_CHARS, shown: Callable[[Column], Column] | None = None) -> tuple[list[str | None], list]:
    """(texts, labels) of different rows of (doc_id, text, label), the first `most_docs` by a hash of their ids,
    without those that `most_chars` has no room for beside those before them. Lengths and hashes settle
    which; only the texts of the sample leave their tasks, each once, however often its row stands there, and
    as what `shown` makes of them."""
    chars = F.coalesce(F.length("text"), F.lit(0)).alias("chars")
    told = rows.select("doc_id", F.xxhash64("text").alias("hash"), chars, F.col(label).alias("y")).where(F.col("chars") <= most_chars)
    first = told.distinct().orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id", "chars", "hash", "y").limit(most_docs).collect()
    places, held = [], 0
    for row in first:
        if held + row.chars <= most_chars:
            places.append((row.doc_id, row.hash, row.y, len(places)))
            held += row.chars
    chosen = rows.sparkSession.createDataFrame(places, told.select("doc_id", "hash", "y").schema.add("place", "integer"))
    text = rows.select("doc_id", F.xxhash64("text").alias("hash"), F.col(label).alias("y"), "text")
    same = [text[c].eqNullSafe(chosen[c]) for c in ("doc_id", "hash", "y")]
    found = text.join(F.broadcast(chosen), same).groupBy("place").agg(F.first("text").alias("text"))
    if shown:
        found = found.select("place", shown(F.col("text")).alias("text"))
    found = found.toArrow()
    texts = dict(zip(found.column("place").to_pylist(), found.column("text").to_pylist()))
    return [texts[p] for *_, p in places], [y for *_, y, _ in places]


def with_score(df: DataFrame, model, keep: list[str], text_col: str = "text", name: str = "score", most: int = 4 << 20) -> DataFrame:
    """The columns `keep` and the model's score of `text_col`; a column that has the score's name gives way."""
    token, sent = uuid.uuid4().hex, df.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in keep if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if token not in KEPT:
            KEPT.clear()
            KEPT[token] = sent.value.scorer()
        score: Callable = KEPT[token]
        for batch in batches:
            for part in slices(batch, column=0, most=most):
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(score(part.column(0).to_pylist()), pa.float64())], [*keep, name])
        give_back(kept=False)

    fields = df.select(*keep).schema.add(name, "double")
    return df.select(F.col(text_col).alias("_scored"), *keep).mapInArrow(run, fields)
