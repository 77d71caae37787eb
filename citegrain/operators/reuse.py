"""Answer reuse: keys, expiry, attribution over a log, and guarded similarity joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import text as T
from ..storage import stored
from .anchors import with_anchor
from .guards import Guard
from .retrieval import cosine_block_join, join_blocks, similar_pairs


def is_cacheable(documents: Column, error: Column, answer: Column, sources: Column) -> Column:
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    return empty(documents) & (T.text(error) == "") & (F.trim(T.text(answer)) != "") & ~empty(sources)


def ttl_for(time_sensitive: Column) -> Column:
    return F.when(F.coalesce(time_sensitive, F.lit(True)), DEFAULTS.ttl_time_sensitive_s).otherwise(DEFAULTS.ttl_s)


def semantic_eligible(enabled: Column, exact_hit: Column, history: Column, embedding: Column) -> Column:
    return enabled & ~exact_hit & (F.coalesce(F.size(history), F.lit(0)) <= 0) & embedding.isNotNull()


def answer_key(question: Column, user_name: Column, model: Column, history: Column, version: str = "v1") -> Column:
    """Equal for equal normalised questions, names, models and last four turns (query, answer)."""
    last = F.slice(F.reverse(F.coalesce(history, F.array().cast("array<struct<query:string,answer:string>>"))), 1, DEFAULTS.history_turns)
    told = F.transform(last, lambda h: F.struct(T.norm_question(h["query"]).alias("q"), F.substring(F.trim(T.text(h["answer"])), 1, 600).alias("a")))
    return F.sha2(F.to_json(F.struct(F.lit(version).alias("v"), T.norm_question(question).alias("q"), F.trim(T.text(user_name)).alias("n"), T.text(model).alias("m"), told.alias("h"))), 256)


def bucket_key(user_name: Column, model: Column, version: str = "v1") -> Column:
    return F.substring(F.sha2(F.concat_ws("|", F.lit(version), F.trim(T.text(user_name)), T.text(model)), 256), 1, 16)


def url_key(namespace: str, url: Column) -> Column:
    return F.concat(F.lit(namespace + ":"), F.md5(T.text(url)))


def normalize_vector(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors; 0 where one is missing or lengths differ."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)), dot).otherwise(0.0)


def quantize_vector(v: Column, digits: int = 5) -> Column:
    return F.transform(v, lambda x: F.round(x, digits))


def anchored_windows(events: DataFrame, key: str = "user_id", duration_s: int = DEFAULTS.rate_window_s, limit: int = DEFAULTS.rate_limit) -> DataFrame:
    """(key, event_id, window_start, n, exceeded): a key's window starts with its first event and the next one with the
    first event after its end; all events count. An event without a time is in no window."""
    held = with_anchor(events, key, F.lit(True), F.lit(duration_s))
    n = F.when(F.col("ts").isNotNull(), F.col("pos") - F.col("anchor.pos") + 1)
    return held.select(F.col("key").alias(key), "event_id", F.when(F.col("ts").isNotNull(), F.col("anchor.ts")).alias("window_start"), n.alias("n"), (n > limit).alias("exceeded"))


def rate_limit_status(windows: DataFrame, key: str = "user_id", limit: int = DEFAULTS.rate_limit) -> DataFrame:
    """Each key's standing after its last event."""
    last = windows.groupBy(key).agg(F.max_by("n", F.struct("window_start", "n")).alias("used"))
    return last.select(key, "used", F.lit(limit).cast("long").alias("limit"), F.greatest(F.lit(limit) - F.col("used"), F.lit(0)).cast("long").alias("remaining"))


def reuse_attribution(requests: DataFrame, key: str = "query") -> DataFrame:
    """(event_id, kind, stored_event_id, age_s): a request hits if its key's stored answer is younger than the
    lifetime of its label; a miss whose answer is cacheable is stored anew, and a hit doesn't renew. A request without
    a time is a miss that stores nothing."""
    held = with_anchor(requests, key, F.col("cacheable"), ttl_for(F.col("time_sensitive")))
    a = F.col("anchor")
    hit = (a["pos"] < F.col("pos")) & (F.col("ts") < a["ends"])
    age = F.when(hit, F.expr("CAST(CAST(ts - anchor.ts AS INTERVAL SECOND) AS BIGINT)"))
    return held.select("event_id", F.when(hit, "hit").otherwise("miss").alias("kind"), F.when(hit, a["event_id"]).alias("stored_event_id"), age.alias("age_s"))


def reuse_counts(requests: DataFrame, key: str = "query") -> DataFrame:
    """(hits, misses), one row: how many requests `reuse_attribution` tells of each kind. Requests of one key and time are one group: all
    are covered by an earlier answer, or the first cacheable one is stored, for those behind it alone. So groups are chained, not requests."""
    able = F.coalesce(F.col("cacheable"), F.lit(False)) & F.col("ts").isNotNull()
    rows = requests.select(F.col(key).alias("key"), "ts", "event_id", able.alias("able"), ttl_for(F.col("time_sensitive")).alias("lasts"))
    groups = stored(rows.groupBy("key", "ts").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("able"), F.struct("event_id", "lasts"))).alias("first")), "groups")
    named = groups.select("key", "ts", F.struct("first.event_id", "n").alias("event_id"), F.col("first").isNotNull().alias("able"), "first.lasts")
    held = with_anchor(named, "key", F.col("able"), F.col("lasts"))
    a, n = F.col("anchor"), F.col("event_id.n")
    stores, covered = a["pos"] == F.col("pos"), (a["pos"] < F.col("pos")) & (F.col("ts") < a["ends"])
    told = stored(held.select("key", "ts", F.col("event_id.event_id").alias("first"), n.alias("n"), stores.alias("stores"), F.when(stores, n - 1).when(covered, n).otherwise(0).alias("hits")), "told")
    begun = told.where("stores AND n > 1").select(F.col("key").alias("k"), F.col("ts").alias("at"), "first")
    ahead = rows.where("NOT able").join(begun, F.col("key").eqNullSafe(F.col("k")) & (F.col("ts") == F.col("at")) & (F.struct("event_id") <= F.struct(F.col("first").alias("event_id"))))
    parts = told.select("n", "hits").unionAll(ahead.select(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("hits")))
    count = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return parts.agg(count("hits").alias("hits"), count(F.col("n") - F.col("hits")).alias("misses"))


def _vectors(df: DataFrame, *more: str) -> DataFrame:
    """(vec_id, bucket, e, ..) of the rows with a vector and a bucket, which is that of vectors of one length."""
    of_length = F.concat(F.size("e").cast("string"), F.lit("|"), F.col("bucket").cast("string"))
    return df.where("size(e) > 0").select("vec_id", of_length.alias("bucket"), "e", *more).where("vec_id IS NOT NULL AND bucket IS NOT NULL")


def semantic_candidates(
    lookups: DataFrame, index: DataFrame, threshold: float = DEFAULTS.similarity, min_overlap: float = DEFAULTS.word_overlap, max_age_s: int = DEFAULTS.semantic_age_s
) -> DataFrame:
    """(query_id, candidate_id, key, similarity, matched_query, reason, stale): pairs of one bucket that reach the
    threshold. reason is the guards' rejection; stale marks a time-sensitive answer (null: it is) of more than `max_age_s`.

    `lookups` has (vec_id, bucket, e, question, now), `index` (vec_id, bucket, e, question, key, t, time_sensitive), times
    in seconds. Vectors that are missing or of other lengths than the lookup's are no candidates. For a look at the pairs:
    `tried_in_blocks` and `sweep_in_blocks` count them where they are made."""
    near = cosine_block_join(_vectors(lookups), _vectors(index), threshold)
    asked = lookups.select(F.col("vec_id").alias("query_id"), F.col("question").alias("query"), "now")
    held = index.select(F.col("vec_id").alias("candidate_id"), F.col("question").alias("matched_query"), "key", "t", "time_sensitive")
    stale = F.coalesce("time_sensitive", F.lit(True)) & (F.col("now") - F.coalesce("t", F.lit(0)) > max_age_s)
    reason = T.rejection_reason(F.col("query"), F.col("matched_query"), min_overlap)
    return near.join(asked, "query_id").join(held, "candidate_id").select("query_id", "candidate_id", "key", "similarity", "matched_query", reason.alias("reason"), stale.alias("stale"))


def _held(answers: DataFrame) -> DataFrame:
    return answers.where(F.trim(T.text(F.col("answer"))) != "").select("key").distinct().withColumn("stored", F.lit(True))


def _tried(candidates: DataFrame, answers: DataFrame) -> DataFrame:
    """(query_id, won, n_rejected): a lookup tries its candidates best first, and the first that no guard rejects, that isn't
    stale and whose answer (key, answer) is still stored and not blank wins; none is tried after it. `won` is the winner or
    null, n_rejected the candidates that guards rejected up to it. Both are sums that tasks add up, so
    a lookup of many candidates needs no list of them."""
    held = _held(answers)
    order = F.struct((-F.col("similarity")).alias("far"), "candidate_id")
    usable = F.col("reason").isNull() & ~F.col("stale") & F.col("stored").isNotNull()
    tried = stored(candidates.join(held, "key", "left").select("query_id", order.alias("order"), F.struct("candidate_id", "similarity", "matched_query").alias("candidate"), F.col("reason").isNotNull().alias("guarded"), usable.alias("usable")), "tried")
    best = tried.groupBy("query_id").agg(F.min(F.when(F.col("usable"), F.struct("order", "candidate"))).alias("won"))
    before = F.col("guarded") & (F.col("won").isNull() | (F.col("order") < F.col("won.order")))
    return tried.select("query_id", "order", "guarded").join(best, "query_id").groupBy("query_id").agg(F.first("won.candidate").alias("won"), F.count(F.when(before, 1)).alias("n_rejected"))


def _with_traits(df: DataFrame) -> DataFrame:
    """`df` with the fields of its questions' traits, which are taken once for each text."""
    told = df.select("question").distinct().withColumn("traits", T.question_traits(F.col("question")))
    other = told.select(F.col("question").alias("told"), "traits.*")
    return df.join(other, F.col("question").eqNullSafe(F.col("told")), "left").drop("told")


def tried_in_blocks(
    lookups: DataFrame, index: DataFrame, answers: DataFrame, threshold: float = DEFAULTS.similarity, min_overlap: float = DEFAULTS.word_overlap, max_age_s: int = DEFAULTS.semantic_age_s, block: int = 2048
) -> DataFrame:
    """What `_tried` tells of `semantic_candidates`, without a table of pairs. Guards are judged in the blocks, and a block
    tells of each lookup its best usable candidate and how many guards rejected; once a lookup's winner is known, blocks are met again to
    count those rejected before it."""
    traits = ["alike", "compared", "words"]
    infinite = float("inf")
    asked = stored(_vectors(_with_traits(lookups.withColumn("now", F.coalesce(F.col("now").cast("double"), F.lit(infinite)))), "now", *traits), "lookups")
    usable = index.join(_held(answers), "key", "left").withColumn("stored", F.col("stored").isNotNull())
    aged = usable.withColumn("t", F.when(F.coalesce("time_sensitive", F.lit(True)), F.coalesce(F.col("t").cast("double"), F.lit(0.0))).otherwise(F.lit(infinite)))
    held = stored(_vectors(_with_traits(aged), "question", "t", "stored", *traits), "index")
    numbers = lambda t, name: t.column(name).to_numpy()

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        guard, ids, now, t, kept, out = Guard(left, right, min_overlap), numbers(right, "vec_id"), numbers(left, "now"), numbers(right, "t"), numbers(right, "stored"), []
        for q, c, s in similar_pairs(left, right, threshold):
            allowed = guard.allows(q, c)
            rows = np.unique(q)
            rejected = np.bincount(q[~allowed], minlength=left.num_rows)[rows]
            use = allowed & kept[c] & ((t[c] == infinite) | (now[q] - np.where(t[c] == infinite, 0, t[c]) <= max_age_s))
            q, c, s = q[use], c[use], s[use]
            order = np.lexsort((ids[c], -s, q))
            first = order[np.unique(q[order], return_index=True)[1]]
            won = np.full(left.num_rows, -1)
            won[q[first]] = first
            at = won[rows]
            none = at < 0
            pick = lambda values: pa.array(values[at] if len(values) else np.zeros(len(at), values.dtype), mask=none)
            out.append(pa.table({"query_id": left.column("vec_id").take(pa.array(rows)), "candidate_id": pick(ids[c]), "similarity": pick(s), "matched_query": right.column("question").take(pick(c)), "n": pa.array(rejected)}))
        return pa.concat_tables(out)

    def before(left: pa.Table, right: pa.Table) -> pa.Table:
        guard, ids, far, won, out = Guard(left, right, min_overlap), numbers(right, "vec_id"), numbers(left, "similarity"), numbers(left, "candidate_id"), np.zeros(left.num_rows, int)
        for q, c, s in similar_pairs(left, right, far.min() if len(far) else threshold):
            ahead = (s > far[q]) | ((s == far[q]) & (ids[c] < won[q]))
            q, c = q[ahead], c[ahead]
            out += np.bincount(q[~guard.allows(q, c)], minlength=left.num_rows)
        return pa.table({"query_id": left.column("vec_id"), "n": pa.array(out)})

    found = join_blocks(asked, held, best, "query_id bigint, candidate_id bigint, similarity double, matched_query string, n bigint", block)
    order = F.struct((-F.col("similarity")).alias("far"), "candidate_id", "similarity", "matched_query")
    winners = stored(found.groupBy("query_id").agg(F.min(F.when(F.col("candidate_id").isNotNull(), order)).alias("won"), F.sum("n").alias("n_all")), "winners")
    again = asked.join(winners.where("won IS NOT NULL").select(F.col("query_id").alias("vec_id"), "won.similarity", "won.candidate_id"), "vec_id")
    counted = join_blocks(again, held.drop("question", "t", "stored"), before, "query_id bigint, n bigint", block).groupBy("query_id").agg(F.sum("n").alias("n"))
    n_rejected = F.when(F.col("won").isNull(), F.col("n_all")).otherwise(F.coalesce("n", F.lit(0)))
    return winners.join(counted, "query_id", "left").select("query_id", F.when(F.col("won").isNotNull(), F.struct("won.candidate_id", "won.similarity", "won.matched_query")).alias("won"), n_rejected.alias("n_rejected"))


def won(tried: DataFrame) -> DataFrame:
    return tried.where("won IS NOT NULL").select("query_id", "won.*", F.col("n_rejected").alias("n_rejected_before"))


def semantic_reuse(candidates: DataFrame, answers: DataFrame) -> DataFrame:
    """(query_id, candidate_id, similarity, matched_query, n_rejected_before): the candidate that wins each lookup."""
    return won(_tried(candidates, answers))


def purge_stale_index(index: DataFrame, answers: DataFrame) -> DataFrame:
    """Index entries whose answer still exists."""
    return index.join(answers.select("key").distinct(), "key", "left_semi")


def threshold_sweep(candidates: DataFrame, grid: list[float]) -> DataFrame:
    """(threshold, accepted, rejected, accepted_share) over a short grid of thresholds."""
    at = F.explode(F.filter(F.array(*map(F.lit, grid)), lambda g: F.col("similarity") >= g))
    counts = candidates.select(at.alias("threshold"), F.col("reason").isNull().cast("long").alias("ok")).groupBy("threshold").agg(F.sum("ok").alias("accepted"), F.sum(1 - F.col("ok")).alias("rejected"))
    return _with_share(counts)


def _with_share(counts: DataFrame) -> DataFrame:
    return counts.withColumn("accepted_share", F.round(F.col("accepted") / (F.col("accepted") + F.col("rejected")), 4))


def sweep_in_blocks(lookups: DataFrame, index: DataFrame, grid: list[float], min_overlap: float = DEFAULTS.word_overlap, block: int = 2048) -> DataFrame:
    """What `threshold_sweep` tells of `semantic_candidates`, without a table of pairs: a block tells one row for each threshold."""
    steps = np.array(sorted(set(grid)))
    traits = ["alike", "compared", "words"]

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        guard, counts = Guard(left, right, min_overlap), np.zeros((2, len(steps) + 1), int)
        for q, c, s in similar_pairs(left, right, steps[0]):
            reached = np.searchsorted(steps, s, side="right")
            counts += np.bincount(reached + guard.allows(q, c) * (len(steps) + 1), minlength=counts.size).reshape(counts.shape)
        rejected, accepted = counts[:, ::-1].cumsum(axis=1)[:, -2::-1]  # a pair counts at each threshold that it reaches
        return pa.table({"threshold": steps, "accepted": accepted, "rejected": rejected})

    asked, held = (_vectors(_with_traits(df), *traits) for df in (lookups, index))
    made = join_blocks(stored(asked, "lookups"), stored(held, "index"), count, "threshold double, accepted bigint, rejected bigint", block)
    return _with_share(made.groupBy("threshold").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")).where("accepted + rejected > 0"))


def cache_stats(attribution: DataFrame, candidates: DataFrame, answers: DataFrame) -> DataFrame:
    """One row: hits, misses and hit_rate of exact reuse; semantic_hits, semantic_rejected (by guards, up to the winner)
    and rescue_rate, the semantic hits' share of the misses. Rates without lookups are 0."""
    of_kind = lambda kind: F.count(F.when(F.col("kind") == kind, 1)).alias("hits" if kind == "hit" else "misses")
    return stats_of(attribution.agg(of_kind("hit"), of_kind("miss")), _tried(candidates, answers))


def stats_of(exact: DataFrame, tried: DataFrame) -> DataFrame:
    """The row of `cache_stats` from (hits, misses) and lookups that are tried."""
    rate = lambda part, whole: F.when(F.col(whole) > 0, F.round(F.col(part) / F.col(whole), 3)).otherwise(0.0)
    semantic = tried.agg(F.count("won").alias("semantic_hits"), F.coalesce(F.sum("n_rejected"), F.lit(0)).alias("semantic_rejected"))
    counts = exact.crossJoin(F.broadcast(semantic)).withColumn("lookups", F.col("hits") + F.col("misses"))  # one row each
    return counts.select("hits", "misses", "semantic_hits", "semantic_rejected", rate("hits", "lookups").alias("hit_rate"), rate("semantic_hits", "misses").alias("rescue_rate"))


def prune_index(index: DataFrame, cap: int = DEFAULTS.index_cap) -> DataFrame:
    """The newest `cap` entries of each bucket."""
    return index.withColumn("r", F.row_number().over(Window.partitionBy("bucket").orderBy(F.col("t").desc(), "vec_id"))).where(F.col("r") <= cap).drop("r")


def store_answers(turns: DataFrame, path: str) -> None:
    """Cacheable turns with their lifetime, partitioned by day."""
    turns.withColumn("ttl_s", ttl_for(F.col("time_sensitive"))).withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


