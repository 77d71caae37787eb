"""Search results, page selection and ranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import text as T
from ..storage import stored


def normalize_search(log: DataFrame) -> DataFrame:
    """(query_id, position, url, title, domain, snippet, content, favicon) of results with URL and title, from
    (query_id, results array of (url, title, raw_content, content))."""
    rows = log.select("query_id", F.posexplode("results").alias("position", "r")).select("query_id", "position", "r.*")
    domain = T.url_domain(F.col("url"))
    body = F.coalesce(F.nullif("raw_content", F.lit("")), T.text(F.col("content")))
    return rows.where((T.text(F.col("url")) != "") & (T.text(F.col("title")) != "")).select("query_id", "position", "url", "title", domain.alias("domain"), F.substring(T.text(F.col("content")), 1, 300).alias("snippet"), F.substring(body, 1, DEFAULTS.doc_chars).alias("content"), T.favicon_url(F.col("url"), domain).alias("favicon"))


def normalize_images(log: DataFrame) -> DataFrame:
    """(query_id, position, image, thumbnail, domain) of results with an image."""
    rows = log.select("query_id", F.posexplode("images").alias("position", "r")).select("query_id", "position", "r.*").where(T.text(F.col("image")) != "")
    return rows.select("query_id", "position", "image", F.coalesce(F.nullif("thumbnail", F.lit("")), F.col("image")).alias("thumbnail"), F.coalesce(F.nullif("source", F.lit("")), T.url_domain(F.col("url"))).alias("domain"))


def cap_per_domain(results: DataFrame, most: int = DEFAULTS.results_per_domain) -> DataFrame:
    """The first `most` results of each (query, domain)."""
    return results.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "domain").orderBy("position"))).where(F.col("_n") <= most).drop("_n")


def select_pages(results: DataFrame, top_n: int = DEFAULTS.scrape_top_n) -> DataFrame:
    """(turn_id, sub_query, position, url, read): the first sight of each URL in a turn, and whether its page is
    read, which goes by its place in its own sub-query's list."""
    first = Window.partitionBy("turn_id", "url").orderBy("sub_query", "position")
    return results.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("turn_id", "sub_query", "position", "url", (F.col("position") < top_n).alias("read"))


def page_budget(results: DataFrame, top_n: int = DEFAULTS.scrape_top_n) -> DataFrame:
    """The first top_n x sub-queries distinct URLs of each turn."""
    n = results.groupBy("turn_id").agg((F.countDistinct("sub_query") * top_n).alias("budget"))
    first = select_pages(results, top_n).withColumn("n", F.row_number().over(Window.partitionBy("turn_id").orderBy("sub_query", "position")))
    return first.join(n, "turn_id").where("n <= budget").select("turn_id", "n", "url")


def merge_results(existing: DataFrame, new: DataFrame, key: str = "turn_id") -> DataFrame:
    """Ordered union by URL: what is there stays, unseen URLs follow, rows without a URL always join."""
    both = existing.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    seen = F.row_number().over(Window.partitionBy(key, "url").orderBy("_side", "position"))
    return both.withColumn("_n", seen).where("url IS NULL OR url = '' OR _side = 0 OR _n = 1").withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy("_side", "position"))).drop("_n", "_side")


def concat_chunks(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def incremental_extract(urls: DataFrame, extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(work, hits): URLs still to read, and pages that are there."""
    return urls.join(extracted, "url", "left_anti"), extracted.join(urls, "url", "left_semi")


def fallback_union(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """A turn without page content from its first provider takes the second one's rows."""
    content = primary.where("coalesce(content, '') <> ''").select("turn_id").distinct()
    return primary.join(content, "turn_id", "left_semi").unionByName(secondary.join(content, "turn_id", "left_anti"))


def extract_stats(pages: DataFrame) -> DataFrame:
    ok = F.count(F.when(F.col("text").isNotNull(), 1))
    return pages.agg(F.count(F.lit(1)).alias("attempted"), ok.alias("successful"))


def bm25(queries: DataFrame, passages: DataFrame, k: int = DEFAULTS.rerank_top_k, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, rank, chunk_id, score): the best k passages of each query that share a content word with it.
    The queries' terms are joined to the passages' in one pass, so only passages that match travel on. Rows of one chunk_id and
    length are one passage."""
    asked = queries.select("query_id", F.explode(T.content_words(F.col("text"))).alias("term")).distinct()
    # one pass over the passages: the queries' terms, and one empty term each, which stands for its length
    words = passages.select("chunk_id", T.words_in(F.col("text")).alias("w")).select("chunk_id", F.size("w").alias("len"), F.explode(F.array_append("w", F.lit(""))).alias("term"))
    wanted = asked.select("term").distinct().unionAll(asked.sparkSession.sql("SELECT '' AS term"))
    terms = stored(words.join(wanted, "term", "left_semi").groupBy("chunk_id", "len", "term").agg(F.count(F.lit(1)).alias("tf")), "terms")
    stats = terms.where("term = ''").agg(F.sum("tf").cast("double").alias("n_docs"), (F.sum(F.col("len") * F.col("tf")) / F.sum("tf")).alias("avg_len"))
    wanted = terms.where("term <> ''")
    idf = wanted.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(stats))  # one row
    rarity = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = rarity * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    scored = asked.join(wanted.join(idf, "term"), "term").groupBy("query_id", "chunk_id").agg(F.round(F.sum(weight), 6).alias("score"))
    return rerank(scored, k)


def rerank(scored: DataFrame, k: int = DEFAULTS.rerank_top_k) -> DataFrame:
    """(query_id, rank, chunk_id, score): best first, ties by chunk; where a scorer failed, 0.5 in the given order."""
    order = Window.partitionBy("query_id").orderBy(F.coalesce("score", F.lit(0.5)).desc(), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", F.coalesce("score", F.lit(0.5)).alias("score"))


def doc_first(uploaded: DataFrame, web: DataFrame) -> DataFrame:
    """Uploaded passages at score 1 before all web passages: (turn_id, place, text, score)."""
    both = uploaded.select("turn_id", "position", "text", F.lit(1.0).alias("score"), F.lit(0).alias("web")).unionByName(web.select("turn_id", "position", "text", "score", F.lit(1).alias("web")))
    return both.select("turn_id", F.row_number().over(Window.partitionBy("turn_id").orderBy("web", "position")).alias("place"), "text", "score")


def cap_sources(sources: DataFrame, most: int) -> DataFrame:
    return sources.withColumn("_n", F.row_number().over(Window.partitionBy("turn_id").orderBy("idx"))).where(F.col("_n") <= most).drop("_n")


def doc_sources(docs: DataFrame, budget: int = DEFAULTS.max_chunks) -> DataFrame:
    """(turn_id, position, name, url, snippet, chunks_taken): uploaded documents share a budget of passages in order;
    a document counts as a source up to and including the first one beyond the budget."""
    order = Window.partitionBy("turn_id").orderBy("position")
    before = F.coalesce(F.sum("n_chunks").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    full = docs.where(F.trim("text") != "").withColumn("before", before)
    spent = F.coalesce(F.sum((F.col("before") >= budget).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    name = F.coalesce(F.nullif(F.trim(T.text(F.col("name"))), F.lit("")), F.lit("Uploaded file"))
    return full.withColumn("spent", spent).where("spent = 0").select("turn_id", "position", name.alias("name"), F.concat(F.lit("file://"), name).alias("url"), F.substring(F.trim("text"), 1, 160).alias("snippet"), F.greatest(F.least(F.col("n_chunks"), F.lit(budget) - F.col("before")), F.lit(0)).alias("chunks_taken"))


def similar_pairs(left: pa.Table, right: pa.Table, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of left, rows of right, similarity) of two blocks' pairs that reach the threshold, by up to 1024 rows of left."""
    matrix = lambda t: t.column("e").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
    if not left.num_rows or not right.num_rows:
        yield np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        return
    a, b = matrix(left), matrix(right)
    for start in range(0, len(a), 1024):
        s = a[start : start + 1024] @ b.T
        q, c = np.nonzero(s >= threshold - 1e-5)  # only these are rounded
        scaled = s[q, c] * 1e5
        s = np.where(np.abs(scaled - np.trunc(scaled)) == 0.5, np.trunc(scaled) + np.sign(scaled), np.rint(scaled)) / 1e5  # halves away from 0
        reached = s >= threshold
        yield q[reached] + start, c[reached], s[reached]


def join_blocks(lookups: DataFrame, index: DataFrame, meet: Callable[[pa.Table, pa.Table], pa.Table], schema: str, block: int = 2048) -> DataFrame:
    """What `meet` makes of each block of a bucket's lookups and each block of its index, both (vec_id, bucket, ..): the sides of a
    bucket are dealt to blocks of about `block` rows, and each block of lookups meets each block of the index. One of the
    two may be without rows."""
    n_blocks = lambda df, name: df.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / block).alias(name))
    blocks = n_blocks(lookups, "a_blocks").join(n_blocks(index, "b_blocks"), "bucket")
    dealt = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
    own = lambda df: [F.col(c).alias(c) for c in df.columns if c != "bucket"]  # noqa: E731 - names of their own, as both sides may come of one table
    a = lookups.join(blocks, "bucket").select(F.col("bucket").alias("a_bucket"), dealt("a_blocks").alias("a_i"), every("b_blocks").alias("a_j"), *own(lookups))
    b = index.join(blocks, "bucket").select(F.col("bucket").alias("b_bucket"), every("a_blocks").alias("b_i"), dealt("b_blocks").alias("b_j"), *own(index))
    pairs = a.groupBy("a_bucket", "a_i", "a_j").cogroup(b.groupBy("b_bucket", "b_i", "b_j"))
    return pairs.applyInArrow(lambda x, y: meet(x, y), schema)


def cosine_block_join(lookups: DataFrame, index: DataFrame, threshold: float, block: int = 2048) -> DataFrame:
    """(query_id, candidate_id, similarity) of one bucket's vectors by blocked matrix products."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        q, c, s = (np.concatenate(x) for x in zip(*similar_pairs(left, right, threshold)))
        return pa.table({"query_id": left.column("vec_id").take(pa.array(q)), "candidate_id": right.column("vec_id").take(pa.array(c)), "similarity": pa.array(s)})

    own = ["vec_id", "bucket", "e"]
    return join_blocks(lookups.select(*own), index.select(*own), run, "query_id bigint, candidate_id bigint, similarity double", block)
