"""The op queries of this subpackage, by name, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import languages, quality, toxicity
from .bpe import bpe_encode, id_digest
from .common import table
from .filter_audit import filter_audit, words_of
from .jaccard import jaccard_components
from .media import read_media, write_media
from .mixing import mix
from .mtree import top_k
from .pii import pseudonymize
from .repeats import remove_repeats
from .runs import periodic_runs
from .token_counts import prefix_counts
from .training import labelled_sample, residue, with_score

QUERIES: dict = {}
#: The queries' pseudonym key; a user brings one of their own.
PII_KEY = b"citegrain query key, not a secret"
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_digest(bpe_encode(table(spark, sf_dir, "documents")))


@query
def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = read_media(write_media(table(spark, sf_dir, "documents")))
    f = F.col("features")
    feature = F.concat_ws(
        " ",
        F.concat(F.lit("layer="), f.layer), F.concat(F.lit("hz="), f.hz), F.concat(F.lit("channels="), f.channels), F.concat(F.lit("frames="), f.n_frames),
        F.concat(F.lit("samples="), f.n_samples), F.concat(F.lit("table="), f.table_frames, F.lit("/"), f.table_bytes), F.concat(F.lit("crc="), f.crc_checked - f.crc_failed, F.lit("/"), f.crc_checked),
        F.concat(F.lit("seekable="), f.table_entries - f.table_misses, F.lit("/"), f.table_entries), F.concat(F.lit("clipped="), f.clipped), F.concat(F.lit("payload="), F.when(f.payload_ok, "ok").otherwise("damaged")),
        F.concat(F.lit("skipped="), f.skipped_bytes), F.concat(F.lit("tags="), F.array_join(f.tags, "+")), F.concat(F.lit("seek="), F.crc32(F.array_join(f.seek.cast("array<string>"), " "))),
    )
    return read.select(
        "doc_id", "n_bytes", F.octet_length(f.payload).cast("long").alias("payload_bytes"), F.sha2(f.payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(f.payload, -64, 64)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"), (f.n_samples / f.hz).alias("seconds"), f.seek.alias("seek"),
    )


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_counts(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.ToxicityModel:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    texts, toxic = labelled_sample(documents, labels, "toxic", residue(5) != 0, toxicity.TRAIN_DOCS)
    return toxicity.fit(texts, toxic) if len(texts) else toxicity.without_labels()


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(*labelled_sample(documents, labels, "quality", residue(4) != 2, quality.TRAIN_DOCS))
    scored = with_score(documents, model, ["doc_id"], most=quality.SCORED_BYTES)
    return scored.select("doc_id", (residue(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = with_score(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir), ["doc_id"])
    return scored.select("doc_id", (residue(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    kinds = F.array_join(F.array_sort(F.array_distinct(F.col("pii.kind"))), ",")
    return done.select("doc_id", "text", F.size("pii").alias("n_found"), kinds.alias("kinds"))


@query
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), width=3, threshold="0.9")


@query
def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents"), size=400)
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    rest = F.make_valid_utf8(F.col("kept").cast("string"))  # a passage can begin inside a character
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), rest.alias("text"))


@query
def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


ORACLES["op3_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op11_filter_audit"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM d
), f AS (
  SELECT part, [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words),
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(least < doc_id, false)] AS f,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = w.doc_id AND quality = 1) AS good, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = w.doc_id AND toxic = 1) AS toxic FROM w
), c AS (
  SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL
), i AS (
  SELECT unnest([1, 2, 3, 4, 5]) AS i
), o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM i a, i b, i c, i d, i e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), s AS (
  SELECT part, array_to_string(list_transform(o, lambda x: substr('ABCDE', x, 1)), '') AS filter_order, CAST(i AS INT) AS step, o[i] AS own, n, good, toxic,
    f[o[i]] AS fails, len(list_filter(o[:i - 1], lambda x: f[x])) > 0 AS before, len(list_filter(f, lambda x: x)) = 1 AS single FROM c, o, i
), t AS (
  SELECT part, filter_order, step, own, sum(n) FILTER (NOT fails AND NOT before) AS kept, sum(n) FILTER (fails AND NOT before) AS removed, sum(n) FILTER (fails AND before) AS redundant,
    sum(n) FILTER (fails AND single) AS unique_fails, sum(good) FILTER (fails AND NOT before) AS good_lost, sum(toxic) FILTER (fails AND NOT before) AS toxic_lost FROM s GROUP BY ALL
)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM t
"""


@query
def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = languages.identify(documents, languages.train(documents, residue(3) != 1), ["doc_id"])
    return found.select("doc_id", (residue(3) == 1).alias("held_out"), "lang_pred", "score")


@query
def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = periodic_runs(planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))
    # longest by exact quotient: lengths * periods compare as integers
    better = lambda a, b: (a["length"] * b["period"] > b["length"] * a["period"]) | ((a["length"] * b["period"] == b["length"] * a["period"]) & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] < b["period"]))))
    best = F.aggregate("runs", F.try_element_at("runs", F.lit(1)), lambda a, b: F.when(better(b, a), b).otherwise(a))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    told = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    b = F.col("best")
    return done.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), b["start"].alias("start"), b["length"].alias("length"), b["period"].alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def planted_runs(documents: DataFrame) -> DataFrame:
    """One text in ten, by crc32 of its id, ends in copies of a block of its own words, as the query's contract
    asks; rows with a null id keep their text."""
    h, n = F.crc32(F.col("doc_id").cast("string")), F.size("words")
    planted = documents.withColumn("words", words_of(F.col("text"))).withColumn("g", F.floor(h / 10)).withColumn("a", F.expr("CAST(g % nullif(size(words), 0) AS INT)"))
    planted = planted.withColumn("p", F.expr("CAST(1 + (size(words) - a) div (3 + g % 8) AS INT)"))
    block = F.slice("words", F.col("a") + 1, F.col("p"))
    tail = F.flatten(F.array_repeat(block, F.ceil((n - F.col("a")) / F.col("p")).cast("int")))
    text = F.array_join(F.slice(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), F.lit(1), n), " ")
    return planted.withColumn("text", F.when((h % 10 == 0) & (n > 0), text).otherwise(F.col("text"))).select(*documents.columns)
