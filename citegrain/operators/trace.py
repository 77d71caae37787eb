"""From ranked passages to sent and cited sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import text as T


def trace_sources(ranked: DataFrame) -> DataFrame:
    """(turn_id, url, first, score, chunks, preview): one row a source, with its best passage; the earliest on ties."""
    best = F.max_by("text", F.struct("score", (-F.col("position")).alias("p")))
    rows = ranked.where("source_url <> ''").groupBy("turn_id", F.col("source_url").alias("url"))
    return rows.agg(F.min("position").alias("first"), F.max(F.coalesce("score", F.lit(0.0))).alias("score"), F.count(F.lit(1)).alias("chunks"), T.preview(best).alias("preview"))


def source_status(traced: DataFrame, sent: DataFrame, cited: DataFrame) -> DataFrame:
    """Adds status cited / sent / considered and citation_index; `sent` has (turn_id, url), `cited` (turn_id, url, idx)."""
    first = cited.where("url <> ''").groupBy("turn_id", "url").agg(F.min("idx").alias("citation_index"))
    there = sent.where("url <> ''").select("turn_id", "url").distinct().withColumn("sent", F.lit(True))
    status = F.when(F.col("citation_index").isNotNull(), "cited").when(F.col("sent"), "sent").otherwise("considered")
    return traced.join(first, ["turn_id", "url"], "left").join(there, ["turn_id", "url"], "left").withColumn("status", status).drop("sent")


def trace_top(with_status: DataFrame, most: int = DEFAULTS.trace_sources) -> DataFrame:
    """The best `most` sources of each turn: by score, cited ones first on ties, then by first appearance."""
    order = Window.partitionBy("turn_id").orderBy(F.col("score").desc(), (F.col("status") == "cited").desc(), "first")
    ranked = with_status.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.select("turn_id", "rank", "url", T.url_domain(F.col("url")).alias("domain"), F.round("score", 4).alias("score"), "chunks", "status", "citation_index", "preview")


def trace_counts(ranked: DataFrame, sent: DataFrame, cited: DataFrame) -> DataFrame:
    """The funnel of each turn, from passages ranked to sources cited."""
    has = F.col("source_url") != ""
    kept = ranked.groupBy("turn_id").agg(F.count(F.lit(1)).alias("chunks_ranked"), F.count(F.when(has & (F.col("text") != ""), 1)).alias("chunks_kept"), F.countDistinct(F.when(has, F.col("source_url"))).alias("sources_considered"))
    n_sent = sent.groupBy("turn_id").agg(F.countDistinct("url").alias("sources_sent"))
    n_cited = cited.groupBy("turn_id").agg(F.countDistinct("url").alias("sources_cited"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return kept.join(n_sent, "turn_id", "left").join(n_cited, "turn_id", "left").select("turn_id", "chunks_ranked", "chunks_kept", "sources_considered", zero("sources_sent"), zero("sources_cited"))


def trace_is_empty(sources: Column, sub_queries: Column) -> Column:
    return (F.coalesce(F.size(sources), F.lit(0)) <= 0) & (F.coalesce(F.size(sub_queries), F.lit(0)) <= 0)


def sample_traces(turns: DataFrame, rate: float) -> DataFrame:
    """A share of turns that stays the same from run to run."""
    return turns.where(F.pmod(F.crc32(F.col("turn_id").cast("string")), F.lit(10_000)) < int(rate * 10_000))


def stage_summary(ranked: DataFrame, answers: DataFrame) -> DataFrame:
    """(turn_id, chunks, top_score, answer_chars, markers) of each turn's stages."""
    found = ranked.groupBy("turn_id").agg(F.count(F.lit(1)).alias("chunks"), F.max("score").alias("top_score"))
    return answers.join(found, "turn_id", "left").select("turn_id", F.coalesce("chunks", F.lit(0)).alias("chunks"), "top_score", F.length(T.text(F.col("answer"))).cast("long").alias("answer_chars"), F.size(T.citation_markers(F.col("answer"))).cast("long").alias("markers"))


def stage_latency(spans: DataFrame, accuracy: int | None = None) -> DataFrame:
    """(stage, n, mean, highest, error_rate, p95) from spans (stage, duration, failed). With an `accuracy`, p95 is a span's duration
    whose rank is off by n / accuracy at most, from sketches that tasks make and that merge; without, it is exact
    and holds a stage's different durations in one task, for tables that allow it."""
    p95 = F.percentile("duration", 0.95) if accuracy is None else F.percentile_approx("duration", 0.95, accuracy)
    return spans.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("duration"), 4).alias("mean"), F.max("duration").alias("highest"), F.round(F.avg(F.col("failed").cast("int")), 4).alias("error_rate"), p95.alias("p95"))


def stage_outputs(states: DataFrame) -> DataFrame:
    """(turn_id, stage, mode, sub_queries, answer_format, needs_web, sources, chunks, document_chunks, images, ranked_chunks, top_score,
    answer_chars, citations, invalid_citations, confidence, follow_ups): what each stage (triage, search, rerank, synthesize, chat)
    of a turn made, as counts; null is what a stage has no say in. `states` has (turn_id, stage) and whatever columns of
    (mode, sub_queries, answer_format, needs_web, search_results, scraped_content, document_chunks, images, ranked_chunks, draft_answer,
    citations, invalid_citations, confidence, follow_ups) were logged; other stages have no row."""
    there = lambda name, of, none: of(F.col(name)) if name in states.columns else F.lit(none)
    size = lambda name: there(name, lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long"), 0).cast("long")
    chars = there("draft_answer", lambda c: F.length(T.text(c)), 0).cast("long")
    score = there("ranked_chunks", lambda c: F.round(F.coalesce(F.get(c, F.lit(0))["score"], F.lit(0.0)), 4), 0.0).cast("double")
    made = {
        "mode": ("triage", there("mode", lambda c: c, None).cast("string")), "sub_queries": ("triage", size("sub_queries")), "answer_format": ("triage", there("answer_format", lambda c: c["type"], None).cast("string")),
        "needs_web": ("triage", there("needs_web", lambda c: c, None).cast("boolean")), "sources": ("search", size("search_results")), "chunks": ("search", size("scraped_content")), "document_chunks": ("search", size("document_chunks")),
        "images": ("search", size("images")), "ranked_chunks": ("rerank", size("ranked_chunks")), "top_score": ("rerank", score), "answer_chars": ("synthesize chat", chars), "citations": ("synthesize", size("citations")),
        "invalid_citations": ("synthesize", F.coalesce(there("invalid_citations", lambda c: c, 0), F.lit(0)).cast("long")), "confidence": ("synthesize", F.coalesce(there("confidence", lambda c: c, 0.0), F.lit(0.0)).cast("double")),
        "follow_ups": ("synthesize", size("follow_ups")),
    }
    stages = ("triage", "search", "rerank", "synthesize", "chat")
    return states.where(F.col("stage").isin(*stages)).select("turn_id", "stage", *[F.when(F.col("stage").isin(*at.split()), value).alias(name) for name, (at, value) in made.items()])
