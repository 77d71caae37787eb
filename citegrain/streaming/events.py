"""State over request streams, each with its batch twin."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import DEFAULTS
from ..storage import scratch


def rate_limit_stream(events: DataFrame, duration_s: int = DEFAULTS.rate_window_s, limit: int = DEFAULTS.rate_limit) -> DataFrame:
    """The stream twin of `anchored_windows`, keyed by user_id; state is one window's start and count."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, n = state.get if state.exists else (None, 0)
        pdf = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for event, ts in zip(pdf["event_id"], pdf["ts"]):
            if start is None or ts.timestamp() >= start + duration_s:
                start, n = ts.timestamp(), 0
            n += 1
            out.append((key[0], event, pd.Timestamp(start, unit="s").round("us"), n, n > limit))
        state.update((start, n))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "window_start", "n", "exceeded"])

    return events.groupBy("user_id").applyInPandasWithState(fold, "user_id bigint, event_id bigint, window_start timestamp_ntz, n bigint, exceeded boolean", "start double, n bigint", "append", GroupStateTimeout.NoTimeout)


def reuse_stream(requests: DataFrame) -> DataFrame:
    """The stream twin of `reuse_attribution`; expiry goes by event time, so replays agree with it."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stored, at, ttl = state.get if state.exists else (None, 0.0, 0)
        pdf = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for event, ts, sensitive, cacheable in zip(pdf["event_id"], pdf["ts"], pdf["time_sensitive"], pdf["cacheable"]):
            t = ts.timestamp()
            if stored is not None and t < at + ttl:
                out.append((event, "hit", stored, int(t - at)))
                continue
            out.append((event, "miss", None, None))
            if cacheable:
                stored, at, ttl = event, t, DEFAULTS.ttl_time_sensitive_s if sensitive in (None, True) else DEFAULTS.ttl_s
        state.update((stored, at, ttl))
        yield pd.DataFrame(out, columns=["event_id", "kind", "stored_event_id", "age_s"]).astype({"stored_event_id": "Int64", "age_s": "Int64"})

    return requests.groupBy("query").applyInPandasWithState(fold, "event_id bigint, kind string, stored_event_id bigint, age_s bigint", "stored bigint, at double, ttl bigint", "append", GroupStateTimeout.NoTimeout)


def cache_stats_stream(attribution: DataFrame) -> DataFrame:
    return attribution.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def usage_stream(priced: DataFrame, late: str = "1 hour") -> DataFrame:
    """Calls, tokens and cost by day and stage; rows later than the watermark are dropped by Spark."""
    return priced.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "stage").agg(F.count(F.lit(1)).alias("calls"), F.sum("total_tokens").alias("total_tokens"), F.round(F.sum("cost_usd"), 4).alias("cost_usd")).select(F.col("w.start").alias("day"), "stage", "calls", "total_tokens", "cost_usd")


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def run_available(stream: DataFrame, mode: str = "append", place: str | None = None) -> DataFrame:
    """Run a stream over all that is there now and read what it wrote to the shared folder. In complete mode
    each batch replaces the rows of the one before. A later run with the same `place` goes on where this one ended."""
    spark: SparkSession = stream.sparkSession
    place = place or scratch(spark, "stream")
    out = f"{place}/rows"

    def write(batch: DataFrame, batch_id: int) -> None:
        # a batch that is retried after a failure replaces what it wrote before
        batch.write.mode("overwrite").parquet(f"{out}/{batch_id if mode == 'append' else 'all'}")

    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/progress").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    finally:
        spark.conf.set(STATE_STORE, before) if before else spark.conf.unset(STATE_STORE)
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(out)


persist_turns = run_available


def stream_of(spark: SparkSession, folder: str, pattern: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
