"""Stored answers as a bucketed table, and exact reuse as an as-of join that leaves the table where it is.

A stored answer is in force from its time until it expires or the key's next answer replaces it, so that at most one
is in force for a key at any time. The table holds one row for each slot of time that this interval touches, bucketed
and sorted by key and slot: a request looks into one slot, and a key with a long history is spread over its slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import text as T
from ..storage import scratch

#: Requests of one key beyond which they are dealt by salts instead of meeting the key's bucket in one task.
HOT_REQUESTS = 1_000_000
SALTS = 64


def _slot(ts: Column, kind: str) -> Column:
    """Slots of the longest lifetime. Times without a zone count by the clock, so that no session's zone shifts them."""
    clock = F.unix_date(F.to_date(ts)).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    return F.floor((clock if kind == "timestamp_ntz" else F.unix_seconds(ts)) / DEFAULTS.ttl_s)


def intervals(answers: DataFrame) -> DataFrame:
    """The answers (key, event_id, ts, ttl_s, answer) with `until`, when each is no longer in force; those that never
    are, blank ones and those without a key or time go. A key's last answer of one time, by event_id, replaces the others."""
    kind = answers.schema["ts"].dataType.simpleString()
    rows = answers.where("key IS NOT NULL AND ts IS NOT NULL").withColumn("slot", _slot(F.col("ts"), kind))
    # the next answer stands in the same slot or is the first one of the key's next slot that has any
    firsts = rows.groupBy("key", "slot").agg(F.min("ts").alias("first"))
    later = firsts.select("key", "slot", F.lead("first").over(Window.partitionBy("key").orderBy("slot")).alias("later"))
    here = F.lead("ts").over(Window.partitionBy("key", "slot").orderBy("ts", "event_id"))
    ends = F.least(F.col("ts") + F.make_dt_interval(secs=F.col("ttl_s")), F.coalesce("here", "later"))
    timed = rows.withColumn("here", here).join(later, ["key", "slot"]).withColumn("until", ends)
    return timed.where((F.col("until") > F.col("ts")) & (F.trim(T.text(F.col("answer"))) != "")).drop("here", "later")


def save_answers(answers: DataFrame, name: str, buckets: int | None = None, path: str | None = None) -> None:
    """Write the answers as the bucketed table `name`; as many buckets as shuffle partitions, unless told."""
    spark = answers.sparkSession
    kind = answers.schema["ts"].dataType.simpleString()
    last = _slot(F.col("until") - F.expr("INTERVAL '0.000001' SECOND"), kind)
    rows = intervals(answers).withColumn("slot", F.explode(F.sequence(F.col("slot"), last)))
    writer = rows.write.mode("overwrite").option("path", path or scratch(spark, name))
    writer.bucketBy(buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "key", "slot").sortBy("key", "slot").saveAsTable(name)


def exact_reuse(requests: DataFrame, name: str, hot_requests: int | None = None) -> DataFrame:
    """(event_id, key, kind, stored_event_id, answer, age_s): each request (event_id, key, ts) with its key's latest stored answer
    not after it, unless that has expired or is blank. Requests of very many to a key are dealt by salts, to copies of the
    key's few stored rows; all others meet the table in its own buckets."""
    spark = requests.sparkSession
    kind = requests.schema["ts"].dataType.simpleString()
    asked = requests.select("event_id", "key", "ts", _slot(F.col("ts"), kind).alias("slot"))
    table = spark.table(name).select("key", "slot", F.col("event_id").alias("stored_event_id"), F.col("ts").alias("since"), "until", "answer")
    # at most one key in so many requests is hot, so that there are few
    hot = asked.where("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > (hot_requests or HOT_REQUESTS)).select("key")
    in_force = (F.col("ts") >= F.col("since")) & (F.col("ts") < F.col("until"))

    def met(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in on]
        joined = left.alias("l").join(right.alias("r"), [*same, in_force], "left")
        age = F.expr("CAST(CAST(ts - since AS INTERVAL SECOND) AS BIGINT)")
        return joined.select("event_id", "l.key", F.when(F.col("stored_event_id").isNull(), "miss").otherwise("hit").alias("kind"), "stored_event_id", "answer", age.alias("age_s"))

    keys = hot.collect() if hot.take(1) else []
    if not keys:
        return met(asked, table, ["key", "slot"])
    few = F.broadcast(spark.createDataFrame(keys, hot.schema))
    dealt = asked.join(few, "key", "left_semi").withColumn("salt", F.pmod(F.xxhash64("event_id"), F.lit(SALTS)))
    copied = table.join(few, "key", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return met(asked.join(few, "key", "left_anti"), table, ["key", "slot"]).unionAll(met(dealt, copied, ["key", "slot", "salt"]))
