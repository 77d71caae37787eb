"""Logged triage plans and turn records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .citations import confidence
from .evals import FORMATS

PLAN = "struct<mode:string,sub_queries:array<string>,answer_format:struct<type:string,columns:array<string>>,time_sensitive:boolean,needs_web:boolean,follow_ups:array<string>>"


def route_mode(mode: Column, documents: Column) -> Column:
    """Documents force research; else chat if the plan says so."""
    return F.when((F.coalesce(F.size(documents), F.lit(0)) > 0) | (T.text(mode) != "chat"), "research").otherwise("chat")


def run_web(documents: Column, needs_web: Column) -> Column:
    return (F.coalesce(F.size(documents), F.lit(0)) <= 0) | F.coalesce(needs_web, F.lit(True))


def clean_format(fmt: Column) -> tuple[Column, Column]:
    """(type, columns): an unknown type is prose, columns are a table's alone."""
    kind = F.lower(F.trim(T.text(fmt["type"])))
    kind = F.when(kind.isin(*FORMATS), kind).otherwise("prose")
    none = F.array().cast("array<string>")
    return kind, F.when(kind == "table", F.coalesce(T.clean_list(fmt["columns"], 100), none)).otherwise(none)


def parse_plans(log: DataFrame) -> DataFrame:
    """(turn_id, mode, sub_queries, format, columns, time_sensitive, web, follow_ups) from (turn_id, query, raw)."""
    plan = F.from_json(T.salvage_json(F.col("raw")), PLAN)
    rows = log.withColumn("plan", plan)
    kind, columns = clean_format(F.col("plan.answer_format"))
    none = F.array().cast("array<string>")
    return rows.select(
        "turn_id", route_mode(F.col("plan.mode"), none).alias("mode"), T.clean_sub_queries(F.col("plan.sub_queries"), F.col("query")).alias("sub_queries"), kind.alias("format"), columns.alias("columns"),
        F.coalesce("plan.time_sensitive", F.lit(True)).alias("time_sensitive"), run_web(none, F.col("plan.needs_web")).alias("web"), F.coalesce(T.clean_list(F.col("plan.follow_ups"), 4), none).alias("follow_ups"),
    )


def cached_to_turn(payloads: DataFrame) -> DataFrame:
    """Stored payloads as turns, with defaults for what they lack."""
    fill = {"invalid_citations": 0, "time_sensitive": True, "iterations": 1}
    return payloads.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in payloads.columns else F.lit(v) for c, v in fill.items()})


def done_record(turns: DataFrame) -> DataFrame:
    """What a finished turn reports; a cached one used no tokens. From (turn_id, n_sources, latency_ms, kind,
    matched_query, similarity, total_tokens, cost_usd)."""
    cached = F.col("kind").isNotNull()
    return turns.select("turn_id", F.col("n_sources").alias("total_sources"), confidence(F.col("n_sources")).alias("confidence"), "latency_ms", cached.alias("cached"), F.col("kind").alias("cache_kind"), "matched_query", "similarity", F.when(cached, 0).otherwise(F.col("total_tokens")).alias("total_tokens"), F.when(cached, 0.0).otherwise(F.col("cost_usd")).alias("cost_usd"))
