"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Text handled at a time inside a task, so that memory follows this and not the Arrow batch.
SLICE_BYTES = 4 << 20


#: What a worker keeps from task to task: one operator's model at a time.
KEPT: dict = {}


def give_back(kept: bool = True) -> None:
    """Return a worker's freed memory to the system, and what it keeps for an operator too if `kept`: it lives on beside the
    workers of later stages."""
    if kept:
        KEPT.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where it is unset (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="citegrain-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back, which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, column: int = 1, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a record batch into runs of rows whose text stays under `most` bytes (one row at least)."""
    start = held = 0
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for i, n in enumerate(lengths):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings; null is the empty text."""
    return ["" if t is None else t for t in column.to_pylist()]


def local_path(path: str) -> str:
    """A tokenizer file's place: a path as it is, a bare name from the installed vocabularies."""
    if os.sep in path:
        return path
    import public_tokenizers

    return public_tokenizers.path(path)
