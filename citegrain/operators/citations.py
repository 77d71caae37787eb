"""Citation integrity: markers, numbering of sources, and what each answer was given."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import text as T


def with_audit(answers: DataFrame) -> DataFrame:
    """`answers` (answer, n_sources, ...) with n_markers, n_valid_distinct, invalid, n_invalid, utilization and confidence."""
    n = F.coalesce("n_sources", F.lit(0))
    marked = answers.withColumn("_n", n).withColumn("_m", T.citation_markers(F.col("answer")))
    inside = lambda x: (x >= 1) & (x <= F.col("_n"))
    valid = F.size(F.array_distinct(F.filter("_m", inside)))
    invalid = F.array_sort(F.array_distinct(F.filter("_m", lambda x: ~inside(x) & (F.col("_n") > 0))))
    told = marked.withColumns({"n_markers": F.size("_m").cast("long"), "n_valid_distinct": valid.cast("long"), "invalid": invalid})
    return told.withColumns({
        "n_invalid": F.size("invalid").cast("long"), "utilization": F.when(F.col("_n") > 0, F.round(F.col("n_valid_distinct") / F.col("_n"), 6)).otherwise(0.0), "confidence": confidence(F.col("_n")),
    }).drop("_n", "_m")


def citation_audit(answers: DataFrame) -> DataFrame:
    """(turn_id, n_markers, n_valid_distinct, invalid, n_invalid, utilization, confidence) from (turn_id, answer, n_sources)."""
    return with_audit(answers.select("turn_id", "answer", "n_sources")).drop("answer", "n_sources")


def confidence(n_sources):
    return F.round(F.least(F.lit(0.9), F.lit(0.5) + F.lit(0.08) * n_sources), 2)


def resolve_citations(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(turn_id, idx, url, title, claim): one row for each valid distinct marker, with the claim around its first use."""
    used = answers.select("turn_id", "answer", F.explode(F.array_distinct(T.citation_markers(F.col("answer")))).alias("idx"))
    return used.join(sources.select("turn_id", F.col("idx").cast("int").alias("idx"), "url", "title"), ["turn_id", "idx"]).select("turn_id", "idx", "url", "title", T.claim_context(F.col("answer"), F.col("idx")).alias("claim"))


def number_sources(ranked: DataFrame, max_sources: int = DEFAULTS.max_sources, max_chunks: int = DEFAULTS.max_chunks) -> DataFrame:
    """(turn_id, idx, url, position, text): passages in rank order from the first `max_sources` distinct sources,
    `max_chunks` at most, with the surviving sources numbered by first use."""
    turn = Window.partitionBy("turn_id")
    # all windows below are by turn, so one shuffle serves them
    full = ranked.where("source_url <> '' AND text <> ''").repartition("turn_id").withColumn("first", F.min("position").over(Window.partitionBy("turn_id", "source_url")))
    known = full.withColumn("src", F.dense_rank().over(turn.orderBy("first"))).where(F.col("src") <= max_sources)
    kept = known.withColumn("n", F.row_number().over(turn.orderBy("position"))).where(F.col("n") <= max_chunks)
    return kept.withColumn("idx", F.dense_rank().over(turn.orderBy("first"))).select("turn_id", "idx", F.col("source_url").alias("url"), "position", "text")


def enrich_sources(numbered: DataFrame, results: DataFrame) -> DataFrame:
    """Numbered sources with title, domain and favicon of the search result of their URL; of results that
    share a turn and URL the last wins."""
    last = results.groupBy("turn_id", "url").agg(F.max_by("title", "idx").alias("title"))
    firsts = numbered.groupBy("turn_id", "idx", "url").agg(F.min_by("text", "position").alias("snippet"))
    domain = T.url_domain(F.col("url"))
    return firsts.join(last, ["turn_id", "url"], "left").select("turn_id", "idx", "url", F.coalesce(F.nullif("title", F.lit("")), domain).alias("title"), domain.alias("domain"), T.favicon_url(F.col("url"), domain).alias("favicon"), F.substring("snippet", 1, 200).alias("snippet"))


def cited_context(enriched: DataFrame, numbered: DataFrame) -> DataFrame:
    """(turn_id, context): numbered blocks of title, domain and evidence."""
    evidence = numbered.groupBy("turn_id", "idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), "\n").alias("evidence"))
    block = F.concat(F.lit("["), F.col("idx"), F.lit("] "), F.col("title"), F.lit(" ("), F.col("domain"), F.lit(")\n"), F.col("evidence"))
    blocks = enriched.join(evidence, ["turn_id", "idx"]).select("turn_id", F.struct("idx", block.alias("block")).alias("b"))
    return blocks.groupBy("turn_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda x: x["block"]), "\n\n").alias("context"))


def sources_prompt(enriched: DataFrame) -> DataFrame:
    """(turn_id, prompt): numbered list of sources with snippet and URL."""
    snippet = F.when(F.col("snippet") != "", F.concat(F.lit("    "), F.substring("snippet", 1, 200), F.lit("\n"))).otherwise("")
    line = F.concat(F.lit("["), F.col("idx"), F.lit("] "), F.col("title"), F.lit(" ("), F.col("domain"), F.lit(")\n"), snippet, F.lit("    URL: "), F.col("url"), F.lit("\n"))
    return enriched.groupBy("turn_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", line.alias("line")))), lambda x: x["line"]), "\n").alias("prompt"))
