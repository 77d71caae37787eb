"""Corpus pipeline: toxic documents go, near duplicates go, personal data gets pseudonyms, sources are
mixed to their weights, and what is left becomes token ids.

Each stage takes (spark, docs, sf_dir) and returns the next stage's documents, with the columns of
documents; the last one returns ids and the text that they decode to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegrain.llm.bpe import bpe_round_trip
from citegrain.llm.common import materialize, table
from citegrain.llm.jaccard import row_components
from citegrain.llm.mixing import mix, repeated
from citegrain.llm.pii import pseudonymize
from citegrain.llm.registry import PII_KEY, toxicity_model
from citegrain.llm.training import with_score


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.5, empty ones among them."""
    scored = with_score(docs, toxicity_model(spark, sf_dir), docs.columns, name="_toxic")
    return scored.where(F.col("_toxic") < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by similarity 0.8 on five-word shingles, one row: of the smallest id, then of
    the smallest hash of its text, then the smallest in its columns. Null ids come last. Rows without words
    stay."""
    found = row_components(docs, width=5, threshold="0.8")
    rows = materialize(found.select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), "n", "root"), "groups")
    counted = rows.where("n > 0").groupBy("root", "_id", "_hash").agg(F.count(F.lit(1)).alias("_rows"))
    least = F.min(F.struct(F.col("_id").isNull().alias("_none"), "_id", "_hash", "_rows")).alias("_least")
    kept = counted.groupBy("root").agg(least).select("_least._id", "_least._hash", "_least._rows")
    without = rows.where("n = 0").select("_id", "_hash").distinct().withColumn("_rows", F.lit(1).cast("long"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.xxhash64("text"))
    held = materialize(docs.join(kept.unionAll(without), same).select(*docs.columns, "_id", "_hash", "_rows"), "held")
    one = held.where("_rows > 1").groupBy("_id", "_hash").agg(F.min(F.struct(*docs.columns)).alias("_row")).select("_row.*")
    return held.where("_rows = 1").select(*docs.columns).unionByName(one)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms, and their lengths."""
    return pseudonymize(docs, PII_KEY, found=None).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return repeated(docs, mix(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, text): the ids, and the text decoded from them."""
    return bpe_round_trip(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").cast("string").alias("text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("pii", replace_personal_data),
    ("mixing", mix_sources),
    ("byte_level_bpe", encode),
]
#: No SQL expresses a trained classifier, keyed pseudonyms or drawn copies; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
