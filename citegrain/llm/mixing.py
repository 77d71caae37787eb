"""Mix sources to target weights by pivotal dependent rounding.

Each document of a source gets target / size of the source copies: a whole number and a fractional
probability. The longest fractional document is then paired with the pool of the others: word mass
moves from one to the other, in a direction drawn so that every document's expected copies stay what they
were, until one of them is integral. The words of a source are therefore kept exactly until a single
fractional document is left, a short one, and that one is rounded by its probability. A document that
outweighs what the others can make up for goes the way that they can, so that targets come before the
expectation of such a document. Documents meet inside buckets first; the one residual of each bucket goes on to the next level
of a reduction tree of fixed fan-in.

Draws hash the documents' ids and texts with the seed, so reruns agree. Documents without words are rounded by
themselves and take nothing. Null texts have no words; null is a source of its own, last. Repeated rows are
documents of their own. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Documents that meet in a bucket, at about; residuals that a node of the tree combines.
BUCKET_ROWS = 1024
#: Sources that are broadcast at most, and the parts of a source beyond that.
BROADCAST_SOURCES, SALTS = 10_000, 32
WEIGHTS = (5.0, 2.0, 1.0)
_MASK = (1 << 64) - 1


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) for each source.

    A level L of words per unit of weight is found so that the targets min(most * size, weight * L)
    sum to share * all sizes; sources reach their cap in the order of cap / weight.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("cap_at", "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    with_weight = sizes.withColumn("place", F.row_number().over(place)).withColumn("weight", weight)
    with_cap = with_weight.withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("cap_at", F.col("cap") / F.col("weight"))
    total = with_cap.withColumn("words", F.lit(share) * F.sum("source_size").over(Window.partitionBy()))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    from_here = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("words") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(from_here)
    # the level holds at the first source that isn't capped when all before it are
    levels = total.withColumn("level", level).withColumn("at", F.row_number().over(by_cap))
    first = F.min(F.when(F.col("level") <= F.col("cap_at"), F.struct("at", "level"))).over(Window.partitionBy())["level"]
    return levels.select("source", "source_size", F.least("cap", F.coalesce(F.col("weight") * first, F.col("cap"))).alias("target"))


def _mix64(x: int) -> int:
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _MASK
    return x ^ x >> 31


def _draw(*words: int) -> float:
    """A number in [0, 1) that depends on the words alone."""
    x = 0
    for word in words:
        x = _mix64((x + int(word)) * 0x9E3779B97F4A7C15 + 0xC2B2AE3D27D4EB4F & _MASK)
    return x / 2.0**64


def meet(keys: np.ndarray, sizes: np.ndarray, p: np.ndarray, seed: int, last: bool) -> tuple[np.ndarray, int | None]:
    """(copies 0 or 1 or the residual's probability, the residual's index) of documents in falling order of size; where
    `last`, the residual is rounded too.

    The longest fractional document meets the pool of all others: words move between it and the pool, whose members all
    shift by the same probability, until it or a member is integral. So long documents settle while there is a
    pool to make up for them, and what is left over is short. At the root a document so long that the pool can make up for
    one way only takes that way: the source then keeps its target, and this document alone not its expectation."""
    p, done = p.astype(float).copy(), 1e-9
    for i in np.flatnonzero(sizes == 0):  # no words to move
        p[i] = float(_draw(keys[i], seed, i) < p[i])
    p[p < done], p[p > 1 - done] = 0, 1
    left = np.flatnonzero((p > 0) & (p < 1))
    while len(left) > 1:
        a, pool = left[0], left[1:]
        own, words = float(sizes[a]), float(sizes[pool].sum())
        up = min((1 - p[a]) * own, p[pool].min() * words)  # words that can move to a
        down = min(p[a] * own, (1 - p[pool].max()) * words)
        rises = _draw(keys[a], keys[pool[0]], len(pool), seed) * (up + down) < down
        if last:  # no later pool makes up for a way in which this one runs full or empty
            settles_up, settles_down = up >= (1 - p[a]) * own * (1 - done), down >= p[a] * own * (1 - done)
            rises = settles_up if settles_up != settles_down else rises
        move = up if rises else -down
        p[a] += move / own
        p[pool] -= move / words
        met = p[left]
        met[met < done], met[met > 1 - done] = 0, 1
        p[left] = met
        left = left[(met > 0) & (met < 1)]
    if len(left) == 0:
        return p, None
    held = int(left[0])
    if last:
        p[held] = float(_draw(keys[held], seed) < p[held])
    return p, None if last else held


def with_source_facts(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """`rows` (doc_id, hash, source, ...) with the columns of `facts`, one row for each source, named `of` there. At most
    BROADCAST_SOURCES sources are broadcast; more are joined with salts, so that a source of many rows is dealt to
    SALTS parts."""
    same = F.col("source").eqNullSafe(F.col("of"))
    if facts.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(facts), same).drop("of")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "hash"), F.lit(SALTS)).cast("int"))
    every = facts.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(every, same & (F.col("_salt") == F.col("_part"))).drop("of", "_salt", "_part")


def pivotal_copies(docs: DataFrame, seed: int = 42, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(id, hash, source, size, source_size, target, copies) from rows (id, hash, source, size, source_size, target)."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    dealt = docs.groupBy(F.col("source").alias("of")).agg(F.ceil(F.count(F.lit(1)) / bucket_rows).alias("buckets"))
    dealt = materialize(dealt, "buckets")
    most = dealt.agg(F.max("buckets")).first()[0] or 1
    rows = with_source_facts(docs, dealt).select(
        "doc_id", "hash", "source", "size", "source_size", "target", F.floor(rate).alias("whole"), (rate - F.floor(rate)).alias("p"),
        F.xxhash64(F.lit(seed), "doc_id", "hash").alias("key"), "buckets", F.lit(False).alias("settled"),
    )
    # rows alike in id and text have one key; where they would outgrow a bucket, numbers of their own deal them
    alike = docs.groupBy(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), F.col("source").alias("_of")).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > bucket_rows)
    alike = materialize(alike, "alike")
    if alike.limit(1).count():
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash").eqNullSafe(F.col("_hash"))) & F.col("source").eqNullSafe(F.col("_of"))
        few = F.broadcast(alike) if alike.count() <= BROADCAST_SOURCES else alike
        own = F.when(F.col("_rows").isNotNull(), F.monotonically_increasing_id()).otherwise(0)
        rows = rows.join(few, same, "left").withColumn("dealt", F.xxhash64("key", own)).drop("_id", "_hash", "_of", "_rows")
    else:
        rows = rows.withColumn("dealt", F.col("key"))
    schema = rows.schema

    def run(group: pa.Table) -> pa.Table:
        last = group.column("buckets")[0].as_py() == 1
        group = group.sort_by([("size", "descending"), ("key", "ascending")])
        p, held = meet(group.column("key").to_numpy(), group.column("size").to_numpy(), group.column("p").to_numpy(), seed, last)
        group = group.set_column(group.schema.get_field_index("p"), "p", pa.array(p))
        return group.set_column(group.schema.get_field_index("settled"), "settled", pa.array(np.arange(len(p)) != (-1 if held is None else held)))

    out = None
    while True:
        done = rows.groupBy("source", F.pmod(F.col("dealt"), F.col("buckets"))).applyInArrow(lambda t: run(t), schema)
        done = materialize(done, "mixing")
        out = done.where("settled") if out is None else out.unionByName(done.where("settled"))
        if most <= 1:
            break
        rows = done.where("not settled").withColumn("buckets", F.ceil(F.col("buckets") / bucket_rows))
        most = -(-most // bucket_rows)
    return out.select("doc_id", "hash", "source", "size", "source_size", "target", (F.col("whole") + F.col("p").cast("long")).alias("copies"))


def mix(docs: DataFrame, seed: int = 42, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(doc_id, hash, source, size, source_size, target, copies) for every document; hash is its text's."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"))
    sized = materialize(sized, "sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(source_targets(sizes, weights, share, most).withColumnRenamed("source", "of"), "targets")
    return pivotal_copies(with_source_facts(sized, targets), seed)


def repeated(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """The documents as often as the mix takes them, with all their columns; `copies` has (doc_id, hash,
    source, copies). Rows that share id, text and source share their copies as evenly as whole copies go."""
    mine = ["_id", "_hash", "_source"]
    n = copies.groupBy(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), F.col("source").alias("_source")).agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash")) & F.col("source").cast("string").eqNullSafe(F.col("_source"))
    joined = docs.join(n.where("_copies > 0"), same)
    at = F.row_number().over(Window.partitionBy(*mine).orderBy(*mine))
    several = joined.where("_rows > 1").withColumn("_copies", F.expr("_copies div _rows") + (at <= F.col("_copies") % F.col("_rows")).cast("long"))
    shared = joined.where("_rows = 1").unionByName(several).where("_copies > 0")
    return shared.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*docs.columns)
