"""Chains of anchors in ordered events: each anchor holds for a while, and the next one is the first able event after.

Whether an event is an anchor depends on all before it, yet no key's events need one task. The events of a key that has
few (FOLDED) are folded in place, in one aggregate. Those of all other keys are numbered in their order by range
partitions; each able event is linked to the first able event at or after its end (a merge of ends and times, range
partitioned alike, so that a hot key takes as many tasks as its rows fill); then pointer doubling marks what the
first able event of each key reaches: the links are squared until none is left, and the marks follow the squares from
the longest to the shortest. The number of rounds is the logarithm of the longest chain. Both ways give the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..storage import stored

#: Events of a key that one fold takes at most.
FOLDED = 4096


def _blocks_before() -> WindowSpec:
    """The blocks before a block, in one task: there are as many rows as range partitions, whatever the input."""
    return Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)


def with_ends(events: DataFrame, key: str, able: Column, seconds: Column) -> DataFrame:
    """(key, event_id, ts, able, ends)"""
    told = events.select(F.col(key).alias("key"), "event_id", "ts", (F.coalesce(able, F.lit(False)) & F.col("ts").isNotNull()).alias("able"), F.make_dt_interval(secs=seconds).alias("lasts"))
    return told.select("key", "event_id", "ts", "able", F.when(F.col("able"), F.col("ts") + F.col("lasts")).alias("ends"))


def numbered(events: DataFrame) -> DataFrame:
    """(key, event_id, ts, able, ends) with `block` and `pos` (dense, by key, ts and event_id, nulls first). Blocks are range
    partitions, as many counts as which make the numbers dense."""
    placed = events.repartitionByRange("key", "ts", "event_id").sortWithinPartitions("key", "ts", "event_id").withColumn("place", F.monotonically_increasing_id())
    placed = stored(placed.withColumn("block", F.shiftright("place", 33)).withColumn("place", F.col("place").bitwiseAND((1 << 33) - 1)), "numbered")
    offsets = placed.groupBy("block").agg(F.count(F.lit(1)).alias("n")).select("block", F.coalesce(F.sum("n").over(_blocks_before()), F.lit(0)).alias("offset"))
    return placed.join(F.broadcast(offsets), "block").withColumn("pos", F.col("offset") + F.col("place")).drop("offset", "place")


def links(events: DataFrame) -> DataFrame:
    """(pos, to): the first able event of the key at or after the end of each able event, where there is one."""
    able = events.where("able")
    row = lambda at, is_end: able.select("key", F.col(at).alias("at"), F.lit(is_end).alias("is_end"), "pos")
    # at the same time ends come first, so that an event at an end counts as after it
    merged = row("ts", False).unionAll(row("ends", True)).repartitionByRange("key", "at", F.desc("is_end"), "pos").withColumn("block", F.spark_partition_id())
    merged = stored(merged, "merged")
    target = F.when(~F.col("is_end"), F.struct("key", "pos"))
    later = Window.partitionBy("block").orderBy(F.desc_nulls_last("key"), F.desc("at"), "is_end", F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    found = merged.withColumn("next", F.last(target, ignorenulls=True).over(later)).where("is_end")
    # an end behind the last event of its block goes on to the next block that has one; there are as many rows as blocks
    firsts = merged.where("NOT is_end").groupBy("block").agg(F.min_by(F.struct("key", "pos"), "pos").alias("first"))
    behind = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    edges = merged.select("block").distinct().join(F.broadcast(firsts), "block", "left").select("block", F.last("first", ignorenulls=True).over(behind).alias("beyond"))
    to = F.coalesce("next", "beyond")
    return found.join(F.broadcast(edges), "block").where(to["key"].eqNullSafe(F.col("key"))).select("pos", to["pos"].alias("to"))


def anchors(events: DataFrame) -> DataFrame:
    """(pos): the anchors of numbered events, by pointer doubling."""
    rounds, step = [], stored(links(events), "links")
    while step.take(1):
        rounds.append(step)
        step = stored(step.join(step.select(F.col("pos").alias("to"), F.col("to").alias("far")), "to").select("pos", F.col("far").alias("to")), "links")
    marked = events.where("able").groupBy("key").agg(F.min("pos").alias("pos")).select("pos")
    for step in reversed(rounds):
        marked = marked.join(step, "pos", "left").select(F.explode(F.array_compact(F.array("pos", "to"))).alias("pos"))
    return marked


def _doubled(events: DataFrame) -> DataFrame:
    rows = numbered(events)
    held = F.when(F.col("marked"), F.struct("key", "pos", "event_id", "ts", "ends"))
    marked = rows.join(anchors(rows).withColumn("marked", F.lit(True)), "pos", "left").withColumn("held", held)
    so_far = Window.partitionBy("block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lasts = marked.groupBy("block").agg(F.max_by("held", F.when(F.col("marked"), F.col("pos"))).alias("last"))
    carried = lasts.select("block", F.last("last", ignorenulls=True).over(_blocks_before()).alias("carried"))
    found = marked.withColumn("anchor", F.last("held", ignorenulls=True).over(so_far)).join(F.broadcast(carried), "block")
    anchor = F.coalesce("anchor", "carried")
    own = F.struct(*(anchor[c].alias(c) for c in ("pos", "event_id", "ts", "ends")))
    return found.select("key", "event_id", "ts", "pos", F.when(anchor["key"].eqNullSafe(F.col("key")), own).alias("anchor"))


def _folded(events: DataFrame) -> DataFrame:
    rows = events.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "able", "ends"))).alias("rows"))
    placed = rows.withColumn("rows", F.transform("rows", lambda x, i: x.withField("pos", i.cast("long"))))
    kind = "struct<pos:bigint,event_id:{},ts:{ts},ends:{ts}>".format(events.schema["event_id"].dataType.simpleString(), ts=events.schema["ts"].dataType.simpleString())
    anchor = lambda x: F.struct(x["pos"].alias("pos"), x["event_id"].alias("event_id"), x["ts"].alias("ts"), x["ends"].alias("ends"))
    begin = F.struct(F.lit(None).cast(kind).alias("anchor"), F.array().cast(f"array<{kind}>").alias("found"))

    def step(held: Column, x: Column) -> Column:
        now = F.when(x["able"] & (held["anchor"].isNull() | (x["ts"] >= held["anchor"]["ends"])), anchor(x)).otherwise(held["anchor"])
        return F.struct(now.alias("anchor"), F.array_append(held["found"], now).alias("found"))

    told = placed.withColumn("found", F.aggregate("rows", begin, step, lambda held: held["found"]))
    each = told.select("key", F.explode(F.arrays_zip("rows", "found")).alias("x"))
    return each.select("key", "x.rows.event_id", "x.rows.ts", "x.rows.pos", F.col("x.found").alias("anchor"))


def with_anchor(events: DataFrame, key: str, able: Column, seconds: Column) -> DataFrame:
    """(key, event_id, ts, pos, anchor (pos, event_id, ts, ends)): each event's place in the order of its key and the last anchor up to
    the event itself, null before the first. `seconds` is how long an anchor holds, more than 0; only `able` events
    are anchors."""
    rows = with_ends(events, key, able, seconds)
    many = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FOLDED).select(F.col("key").alias("hot"))
    if not many.take(1):
        return _folded(rows)
    many = stored(many, "hot")
    hot = rows["key"].eqNullSafe(many["hot"])
    return _folded(rows.join(many, hot, "left_anti")).unionAll(_doubled(rows.join(many, hot, "left_semi")))
