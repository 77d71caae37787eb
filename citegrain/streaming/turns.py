"""Event logs folded into turns: stored turns replayed as events, a batch fold, and a stream that buffers events.

Both folds share one rule (`turn_of`), a function of a turn's events in order: tokens are joined, a list of sources
that replaces is swapped in and later ones add what is unseen, the last images, trace and follow-ups win. A turn is
finished when `done` and all events before it are there (`seq` counts from 0), whatever order they came in. An error
before `done` suppresses the turn. A pause of more than `idle_s` between events ends it unfinished, with error 'timeout'
and what there was before the pause. Repeated events count once; the earliest stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as T

SOURCE = "struct<idx:bigint,url:string,title:string>"
EVENTS = "array<struct<seq:int,ts:timestamp,type:string,payload:string>>"
#: Seconds without an event after which a turn is given up.
IDLE_S = 300


def replay_events(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(turn_id, seq, type, payload): the events that would show a stored turn again. `answers` has (turn_id, query, answer)
    and, where stored, sub_queries, images (arrays), trace (a struct with arrays sources and sub_queries) and follow_ups (an
    array). Empty sections are left out, the token always comes; without sub_queries the query stands for them."""
    listed = sources.groupBy("turn_id").agg(F.array_sort(F.collect_list(F.struct("idx", "url", "title"))).alias("_sources"))
    has = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    event = lambda kind, payload: F.struct(F.lit(kind).alias("type"), F.to_json(payload).alias("payload"))
    there = lambda c, kind, name: [F.when(has(F.col(c)), event(kind, F.struct(F.col(c).alias(name))))] if c in answers.columns else []
    asked = there("sub_queries", "sub_queries", "queries") or [F.when(T.text(F.col("query")) != "", event("sub_queries", F.struct(F.array("query").alias("queries"))))]
    traced = [F.when(has(F.col("trace.sources")) | has(F.col("trace.sub_queries")), event("trace", F.col("trace")))] if "trace" in answers.columns else []
    events = F.array_compact(F.array(
        *asked,
        F.when(has(F.col("_sources")), event("sources", F.struct(F.col("_sources").alias("sources"), F.lit(True).alias("replace")))),
        *there("images", "images", "images"),
        # fixed values: the phase that a replay shows
        event("phase", F.struct(F.lit("writing").alias("phase"), F.lit("Synthesizing your answer...").alias("message"))),
        event("token", F.struct(T.text(F.col("answer")).alias("token"))),
        *traced,
        *there("follow_ups", "follow_up", "suggestions"),
        event("done", F.struct(F.col("turn_id").alias("id"))),
    ))
    return answers.join(listed, "turn_id", "left").select("turn_id", F.posexplode(events).alias("seq", "e")).select("turn_id", "seq", "e.type", "e.payload")


def merged_sources(payloads: Column) -> Column:
    """The sources of lists in order: one that replaces is taken as it is, any other adds the URLs that aren't there yet."""
    lists = F.transform(payloads, lambda p: F.from_json(p, f"struct<sources:array<{SOURCE}>,replace:boolean>"))
    listed = lambda x: F.coalesce(x["sources"], F.array().cast(f"array<{SOURCE}>"))
    urls = lambda held: F.transform(held, lambda s: F.coalesce(s["url"], F.lit("")))
    unseen = lambda held, x: F.filter(listed(x), lambda s: ~F.array_contains(urls(held), F.coalesce(s["url"], F.lit(""))))
    return F.aggregate(lists, F.array().cast(f"array<{SOURCE}>"), lambda held, x: F.when(F.coalesce(x["replace"], F.lit(False)), listed(x)).otherwise(F.concat(held, unseen(held, x))))


def turn_of(rows: DataFrame, idle_s: int | None, until: Column) -> DataFrame:
    """(turn_id, answer, sources, images, trace, follow_ups, error) of the turns of (turn_id, events) that are over; `events` are
    in order. images and trace are JSON. `until` is the time up to which all events have come, null for all time."""
    ev = F.col("events")
    once = rows.withColumn("events", F.filter(ev, lambda x, i: (i == 0) | (x["seq"] != F.get(ev, i - 1)["seq"])))
    if idle_s is not None:
        idle = F.make_dt_interval(secs=F.lit(idle_s))
        # F.get beyond the last time is null, and so is the comparison
        times = once.withColumn("times", F.array_sort(F.transform(ev, lambda x: x["ts"])))
        pauses = F.filter("times", lambda t, i: F.get(F.col("times"), i + 1) - t > idle)
        once = times.withColumn("pause", F.get(pauses, F.lit(0))).withColumn("last", F.array_max("times")).drop("times")
        once = once.withColumn("events", F.when(F.col("pause").isNull(), ev).otherwise(F.filter(ev, lambda x: x["ts"] <= F.col("pause"))))
        expired = F.col("pause").isNotNull() | until.isNull() | (F.col("last") + idle < until)
    else:
        expired = F.lit(False)
    first = lambda kind: F.array_min(F.transform(F.filter(ev, lambda x: x["type"] == kind), lambda x: x["seq"]))
    ends = once.withColumn("expired", expired).withColumn("done", first("done")).withColumn("failed", first("error"))
    upto = F.filter(ev, lambda x: F.col("done").isNull() | (x["seq"] <= F.col("done")))
    ends = ends.withColumn("events", upto).withColumn("finished", F.col("done").isNotNull() & (F.size(ev) == F.col("done") + 1))
    over = ends.where((F.col("finished") | F.col("expired")) & (F.col("failed").isNull() | (F.col("finished") & (F.col("failed") > F.col("done")))))
    payloads = lambda kind: F.transform(F.filter(ev, lambda x: x["type"] == kind), lambda x: x["payload"])
    last = lambda kind: F.try_element_at(payloads(kind), F.lit(-1))
    answer = F.array_join(F.transform(payloads("token"), lambda p: F.coalesce(F.get_json_object(p, "$.token"), F.lit(""))), "")
    told = F.from_json(last("follow_up"), "struct<suggestions:array<string>>")["suggestions"]
    return over.select(
        "turn_id", answer.alias("answer"), merged_sources(payloads("sources")).alias("sources"), F.get_json_object(last("images"), "$.images").alias("images"), last("trace").alias("trace"),
        told.alias("follow_ups"), F.when(~F.col("finished"), "timeout").alias("error"),
    )


def fold_turns(events: DataFrame, idle_s: int | None = IDLE_S, until: Column | None = None) -> DataFrame:
    """The turns of (turn_id, seq, ts, type, payload) that are over by `until`; idle_s=None knows no timeouts and takes events
    without `ts`."""
    ts = F.col("ts") if "ts" in events.columns else F.lit(None).cast("timestamp")
    rows = events.groupBy("turn_id").agg(F.array_sort(F.collect_list(F.struct(F.col("seq").cast("int").alias("seq"), ts.alias("ts"), "type", "payload"))).alias("events"))
    return turn_of(rows, idle_s, F.lit(None).cast("timestamp") if until is None else until)


def fold_events(events: DataFrame) -> DataFrame:
    """(turn_id, answer, n_sources): turns that are done and had no error before."""
    return fold_turns(events, None).select("turn_id", "answer", F.size("sources").cast("long").alias("n_sources"))


class TurnBuffer(StatefulProcessor):
    """Keeps a turn's events, in whatever order they come, until the turn is over, then tells them all in order. A timer at
    the last event's time and `idle_s` ends a turn that stays silent, and, where it is over, forgets that it was."""

    def __init__(self, idle_s: int):
        self.idle_ms = idle_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "seq int, us bigint, type string, payload string")
        self.told = handle.getValueState("told", "over boolean, done int, us bigint")  # over, seq of done or -1, latest time

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        over, done, latest = self.told.get() if self.told.exists() else (False, -1, -1)
        if over:  # repeated events of a turn that was told already
            for _ in rows:
                pass
            return
        before = latest
        for frame in rows:
            us = frame["ts"].to_numpy().astype("datetime64[us]").astype("int64")
            self.events.appendList(list(zip(map(int, frame["seq"]), us.tolist(), frame["type"], frame["payload"])))
            latest = max(latest, int(us.max()))
            ends = frame.loc[frame["type"] == "done", "seq"]
            done = int(ends.min()) if len(ends) and (done < 0 or ends.min() < done) else done
        if latest != before:
            if before >= 0:
                self.handle.deleteTimer(before // 1000 + self.idle_ms)
            self.handle.registerTimer(latest // 1000 + self.idle_ms)
        if done >= 0:
            held = list(self.events.get())
            if len({e[0] for e in held if e[0] <= done}) == done + 1:
                over = True
                yield self.tell(key, held)
                self.events.clear()
        self.told.update((over, done, latest))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        over, done, latest = self.told.get()
        if over:
            self.told.clear()
            return
        yield self.tell(key, list(self.events.get()))
        self.events.clear()
        self.told.update((True, done, latest))
        self.handle.registerTimer(expiredTimerInfo.getExpiryTimeInMs() + self.idle_ms)

    @staticmethod
    def tell(key: tuple, held: list[tuple]) -> pd.DataFrame:
        events = [{"seq": seq, "ts": pd.Timestamp(us, unit="us"), "type": kind, "payload": payload} for seq, us, kind, payload in sorted(held, key=lambda e: e[:2])]
        return pd.DataFrame({"turn_id": [key[0]], "events": [events]})

    def close(self) -> None:
        pass


def fold_turns_stream(events: DataFrame, idle_s: int = IDLE_S, late: str = "1 minute") -> DataFrame:
    """The stream twin of `fold_turns`, by event time: events of (turn_id, seq, ts, type, payload) that come later than `late`
    behind the newest are dropped by Spark. It needs the RocksDB state store, which `run_available` sets."""
    rows = events.withWatermark("ts", late).select("turn_id", "seq", "ts", "type", "payload").groupBy("turn_id")
    buffered = rows.transformWithStateInPandas(TurnBuffer(idle_s), f"turn_id bigint, events {EVENTS}", "append", "eventTime")
    return turn_of(buffered, idle_s, F.lit(None).cast("timestamp"))


def fold_events_stream(events: DataFrame, idle_s: int = IDLE_S, late: str = "1 minute") -> DataFrame:
    """The stream twin of `fold_events`, with the turns that timed out."""
    return fold_turns_stream(events, idle_s, late).select("turn_id", "answer", F.size("sources").cast("long").alias("n_sources"), "error")
