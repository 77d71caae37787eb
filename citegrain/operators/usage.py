"""Tokens and cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def price_calls(calls: DataFrame, prices: DataFrame, unknown: str = "zero") -> DataFrame:
    """Calls with total_tokens and cost_usd. A model without a price costs 0, or null with unknown='null'.
    Prices are a short dimension, which Spark broadcasts by its own size estimate."""
    cost = (F.col("prompt_tokens") * F.col("prompt_usd") + F.col("completion_tokens") * F.col("completion_usd")) / 1_000_000
    priced = calls.join(prices, "model", "left").withColumn("cost_usd", cost if unknown == "null" else F.coalesce(cost, F.lit(0.0)))
    return priced.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens")).drop("prompt_usd", "completion_usd")


def _totals() -> list:
    return [F.count(F.lit(1)).alias("calls"), *(F.sum(c).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")), F.round(F.sum("cost_usd"), 6).alias("cost_usd")]


def usage_by_turn(priced: DataFrame) -> DataFrame:
    return priced.groupBy("turn_id").agg(*_totals())


def usage_rollup(priced: DataFrame) -> DataFrame:
    """Totals by (turn, stage) and, with a null stage, by turn; calls without a stage count as 'unknown'."""
    named = priced.withColumn("stage", F.coalesce(F.nullif("stage", F.lit("")), F.lit("unknown")))
    return named.groupingSets([["turn_id", "stage"], ["turn_id"]], "turn_id", "stage").agg(*_totals())


def cost_report(priced: DataFrame) -> DataFrame:
    """Spend by day, by user, by both and in all (null: all)."""
    return priced.withColumn("day", F.to_date("ts")).cube("day", "user_id").agg(F.count(F.lit(1)).alias("calls"), F.sum("total_tokens").alias("total_tokens"), F.round(F.sum("cost_usd"), 4).alias("cost_usd"))
