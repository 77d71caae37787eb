"""Exact n-gram Jaccard self-join with T-occurrence search.

1. Texts become sets of hashed shingles; rows of one set are one node.
2. An inverted index holds each set's rarest shingles: shingles are ordered by hash, very common ones
   after all others. Of sets whose similarity reaches t, the first |x| - ceil(t |x|) + l shingles share l
   at least. Lists of one set go; so do sets that share too few of their shingles with any other.
3. Sets that share l shingles with the smallest set of such a list are of one family: near copies are found
   by stars, not pair by pair. Families of which members share one of their rarest listed shingles meet (of k
   listed ones, l of which a link needs, the k - l + 1 in the shortest lists).
4. A family's sets are searched against each other, and those of the smaller of two families that meet against
   the larger's, in chunks of bounded size. Links found are joined into components.

A search keeps sets as their differences from the core of the searched ones (shingles that most of these
hold), so lists of a group of near copies are short. With D the differences and w = |D| - h |x|, h = (1 - t) / (1 + t),
x and y link if and only if w(x) + w(y) <= 2 |D(x) & D(y)|. Pairs with w(x) + w(y) <= 0 are counted by rank; for
the others DivideSkip merges the short lists on a heap, skipping, and probes the long ones by binary search.

Null and blank texts have the empty set, which links with nothing. Repeated rows are nodes of one set
and so of one component. A row is known by its id and a hash of its text, so ids that are null or stand
on several texts lose and invent no links. Nothing is dropped or capped: groups of any size are split
into chunks, not cut. Which shingles are very common decides work, never results.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, materialize, slices
from .components import components
from .shingles import Shingler, set_key

#: Sets and shingles of a chunk, at about.
CHUNK_DOCS, CHUNK_SHINGLES = 4096, 1 << 20
#: The table of very common shingles has so many at most; a task tells of those that so great a share of its sets have.
COMMON, COMMON_SHARE = 1 << 17, 1 / 2048
#: DivideSkip's cost of a binary probe against a heap step.
MU = 0.05
NO_ID = -(1 << 63)


def shared_at_least(n: int, t: Fraction) -> int:
    """l: how many shingles of their prefixes two linked sets of n or more shingles share."""
    return 1 + (n - math.ceil(t * n) + 1) // 2


def _shared(n: Column, t: Fraction) -> Column:
    p, q = t.numerator, t.denominator
    return F.floor((n - F.floor((p * n + (q - 1)) / q) + 3) / 2)


def prefix(shingles: np.ndarray, common: np.ndarray, t: Fraction) -> np.ndarray:
    """The shingles under which a set is indexed: in ascending order, very common ones last."""
    n = len(shingles)
    at = np.minimum(np.searchsorted(common, shingles), max(0, len(common) - 1))
    late = common[at] == shingles if len(common) else np.zeros(n, bool)
    ordered = np.concatenate([shingles[~late], shingles[late]])
    return ordered[: n - math.ceil(t * n) + shared_at_least(n, t)]


def divide_skip(lists: list[list[int]], need: int) -> list[tuple[int, int]]:
    """(id, overlap) of the ids that stand in at least `need` of the sorted lists."""
    if need > len(lists):
        return []
    lists = sorted(lists, key=len)
    n_long = min(need - 1, int(need / (MU * math.log2(max(2, len(lists[-1]))) + 1)))
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    least = need - n_long
    heap = [(ids[0], k, 0) for k, ids in enumerate(short)]
    heapq.heapify(heap)
    found = []
    while len(heap) >= least:
        top, popped = heap[0][0], []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap))
        if len(popped) >= least:
            overlap = len(popped)
            for left, ids in zip(range(n_long, 0, -1), long):
                if overlap + left < need:
                    break
                at = bisect_left(ids, top)
                overlap += at < len(ids) and ids[at] == top
            if overlap >= need:
                found.append((top, overlap))
            ahead = [(k, at + 1) for _, k, at in popped]
        else:
            # ids below the next top stand in fewer than `least` short lists: skip them
            while heap and len(popped) < least - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                break
            ahead = [(k, bisect_left(short[k], heap[0][0], at)) for _, k, at in popped]
        for k, at in ahead:
            if at < len(short[k]):
                heapq.heappush(heap, (short[k][at], k, at))
    return found


class Joined:
    """Edges of a spanning forest."""

    def __init__(self, n: int):
        self.up, self.edges = list(range(n)), []

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def add(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.edges.append((a, b))


def search(sets: list[np.ndarray], copies: np.ndarray, n_index: int, t: Fraction) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(a spanning forest of the links, rows that each set links to) between the first `n_index` sets and the
    others, or among themselves where there are no others."""
    same, n = n_index == len(sets), len(sets)
    asked = range(n_index) if same else range(n_index, n)
    flat, times = np.unique(np.concatenate(sets[:n_index]), return_counts=True)
    core = flat[2 * times > n_index]
    apart = [np.setxor1d(s, core, assume_unique=True) for s in sets]
    p, q = t.numerator, t.denominator
    w = np.array([(q + p) * len(d) - (q - p) * len(s) for d, s in zip(apart, sets)])
    links, forest = np.zeros(n, np.int64), Joined(n)
    sides = [(np.arange(n_index), np.asarray(asked))] if same else [(np.arange(n_index), np.asarray(asked)), (np.asarray(asked), np.arange(n_index))]
    after = None
    for there, here in sides:
        # w(x) + w(y) <= 0: a run of the sets in the order of w, all linked with its first
        order = there[np.argsort(w[there], kind="stable")]
        upto = np.searchsorted(w[order], -w[here], "right")
        links[here] += np.concatenate([[0], np.cumsum(copies[order])])[upto]
        after = (w[order], upto) if after is None else after
        for x in here[upto > 0].tolist():
            forest.add(x, int(order[0]))
    if same:
        links -= np.where(2 * w <= 0, copies, 0)
    ranked, upto = after
    owner = np.repeat(np.arange(n_index), [len(d) for d in apart[:n_index]])
    tokens = np.concatenate(apart[:n_index])
    by_token = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[by_token], owner[by_token]
    for x, k in zip(asked, upto.tolist()):
        if k == n_index:
            continue
        need = max(1, -(-int(w[x] + ranked[k]) // (2 * (q + p))))
        if need > len(apart[x]):
            continue
        first, last = np.searchsorted(tokens, apart[x]), np.searchsorted(tokens, apart[x], "right")
        lists = [owner[a:b].tolist() for a, b in zip(first.tolist(), last.tolist()) if b > a]
        for y, overlap in divide_skip(lists, need):
            if (not same or y < x) and 0 < w[x] + w[y] <= 2 * (q + p) * overlap:
                links[x] += copies[y]
                links[y] += copies[x]
                forest.add(x, y)
    return forest.edges, links


def _first_pass(df: DataFrame, width: int) -> DataFrame:
    """Rows of two kinds from (doc_id, text, hash): a document (doc_id, n, key, hash), and shingles that several
    sets of a task have (shingle, sets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        shingler, told, held, size, sets = Shingler(width), set(), [], 0, 0
        none = lambda k: pa.nulls(k, pa.int64())

        def common() -> pa.RecordBatch:
            shingles, n = np.unique(np.concatenate([*held, np.empty(0, np.uint64)]), return_counts=True)
            on = n >= max(2, sets * COMMON_SHARE)
            k = int(on.sum())
            columns = [none(k), none(k), none(k), none(k), pa.array(shingles[on].view(np.int64)), pa.array(n[on], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, FIRST)

        for batch in batches:
            for part in slices(batch):
                n, keys = [], []
                for text in part.column(1).to_pylist():
                    s = shingler(text)
                    key = set_key(s)
                    n.append(len(s))
                    keys.append(key)
                    if len(s) and key not in told:
                        told.add(key)
                        held.append(s)
                        size, sets = size + len(s), sets + 1
                k = len(n)
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.int64()), part.column(2), none(k), none(k)]
                yield pa.RecordBatch.from_arrays(columns, FIRST)
                if size > 4 << 20:
                    yield common()
                    told.clear()
                    held, size, sets = [], 0, 0
        yield common()
        del shingler, told, held
        give_back()

    return df.select("doc_id", "text", "hash").mapInArrow(run, ", ".join(f"{c} bigint" for c in FIRST))


FIRST = ["doc_id", "n", "key", "hash", "shingle", "sets"]


def _postings(df: DataFrame, width: int, t: Fraction, common: np.ndarray) -> DataFrame:
    """(shingle, key) of each set's prefix; sets that a task has lately seen tell nothing."""
    sent = df.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, told = Shingler(width), set()
        for batch in batches:
            for part in slices(batch, column=0):
                found, keys = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
                for text in part.column(0).to_pylist():
                    s = shingler(text)
                    key = set_key(s)
                    if not len(s) or key in told:
                        continue
                    if len(told) > 1_000_000:
                        told.clear()
                    told.add(key)
                    found.append(prefix(s, sent.value, t))
                    keys.append(np.full(len(found[-1]), key))
                columns = [pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(keys))]
                yield pa.RecordBatch.from_arrays(columns, ["shingle", "key"])
        del shingler, told
        give_back()

    return df.select("text").mapInArrow(run, "shingle bigint, key bigint")


def _in_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (shingle, key) in order, the distinct rows whose shingle several keys have, as they stream by."""
    shingles = keys = np.empty(0, np.int64)  # the last row, which the next one decides on
    joined = False
    for batch in batches:
        shingles = np.concatenate([shingles, batch.column(0).to_numpy()])
        keys = np.concatenate([keys, batch.column(1).to_numpy()])
        alike = shingles[1:] == shingles[:-1]
        fresh = np.concatenate([[True], ~(alike & (keys[1:] == keys[:-1]))])[: len(keys)]
        shingles, keys = shingles[fresh], keys[fresh]
        if not len(keys):
            continue
        alike = shingles[1:] == shingles[:-1]
        on = np.concatenate([[joined], alike]) | np.concatenate([alike, [False]])
        yield pa.RecordBatch.from_arrays([pa.array(shingles[:-1][on[:-1]]), pa.array(keys[:-1][on[:-1]])], ["shingle", "key"])
        joined, shingles, keys = bool(on[-1]), shingles[-1:], keys[-1:]
    if joined:
        yield pa.RecordBatch.from_arrays([pa.array(shingles), pa.array(keys)], ["shingle", "key"])


def packed(df: DataFrame) -> DataFrame:
    """(id, hash, packed): texts compressed, for shuffles that carry whole texts; null texts are empty. Rows of
    an id and text that a task has lately seen tell nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, told = zstandard.ZstdCompressor(level=1), set()
        for batch in batches:
            for part in slices(batch, column=2):
                rows = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist()))
                if len(told) > 1_000_000:
                    told.clear()
                on = []
                for row in rows:
                    on.append(row not in told)
                    told.add(row)
                part = part.filter(pa.array(on, pa.bool_()))
                data = [pack.compress((text or "").encode()) for text in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(data, pa.binary())], ["id", "hash", "packed"])
        del told
        give_back()

    return df.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "hash", "text").mapInArrow(run, "id bigint, hash bigint, packed binary")


def _searched(asked: DataFrame, texts: DataFrame, width: int, t: Fraction) -> DataFrame:
    """Links of the groups in `asked` (block, kind, i, j, key, copies, other): between the rows that aren't other and
    those that are, or among the former. Rows are of two kinds: an edge (a, b), and how many rows a set links to (a, n)."""
    within = ["block", "kind", "i", "j"]

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("other", "ascending"), ("key", "ascending")]).combine_chunks()
        keys, other = group.column("key").to_numpy(), group.column("other").to_numpy(zero_copy_only=False)
        fresh = np.concatenate([[True], (keys[1:] != keys[:-1]) | (other[1:] != other[:-1])])  # a row can stand there twice
        group, keys, other = group.filter(pa.array(fresh)), keys[fresh], other[fresh]
        n_index, among = int((~other).sum()), group.column("kind")[0].as_py() == 0 and group.column("i")[0] == group.column("j")[0]
        edges, links = [], np.zeros(len(keys), np.int64)
        if n_index and (among or n_index < len(keys)):
            shingler, unpack = Shingler(width), zstandard.ZstdDecompressor()
            sets = [shingler(unpack.decompress(x).decode()) for x in group.column("packed").to_pylist()]
            edges, links = search(sets, group.column("copies").to_numpy(), n_index, t)
        on = np.flatnonzero(links)
        ends = np.array(edges, np.int64).reshape(-1, 2)
        none = lambda k: pa.nulls(k, pa.int64())
        a = pa.array(np.concatenate([keys[ends[:, 0]], keys[on]]))
        b = pa.chunked_array([pa.array(keys[ends[:, 1]]), none(len(on))])
        return pa.table({"a": a, "b": b, "n": pa.chunked_array([none(len(ends)), pa.array(links[on])])})

    rows = asked.join(texts, "key").select(*within, "key", "copies", "other", "packed")
    return rows.groupBy(*within).applyInArrow(lambda g: run(g), "a bigint, b bigint, n bigint")


def jaccard_components(
    docs: DataFrame, width: int = 3, threshold: str = "0.9", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links): component_id is the smallest doc_id reachable by links
    of similarity >= threshold, null where no row reached has one; n_links is the number of other rows
    whose similarity to this one is >= threshold, copies among them."""
    found = row_components(docs, width, threshold, id_col, text_col)
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "n_links")


def _dealt(rows: DataFrame, by: str, most: int) -> DataFrame:
    """`rows` with `chunk` and `chunks`: rows of one value of `by` dealt to chunks of about `most`."""
    n = rows.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / most).alias("chunks"))
    return rows.join(n, by).withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))


def _each(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))


def row_components(
    docs: DataFrame, width: int, threshold: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, hash, n, root, component_id, n_links) of each row; hash is the text's xxhash64. Rows of one
    root are linked, but for those without shingles (n = 0), which link with nothing."""
    t = Fraction(threshold)
    text = F.col(text_col).cast("string")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("hash"))
    rows = materialize(_first_pass(docs, width), "shingles")
    nodes = rows.where("key IS NOT NULL").select("doc_id", "n", "key", "hash")
    often = rows.where("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("sets").alias("sets"))
    most = often.orderBy(F.col("sets").desc(), "shingle").limit(COMMON).select("shingle").toArrow()
    common = np.sort(most.column("shingle").to_numpy().view(np.uint64))
    # one document for each set
    row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "hash")).alias("row")
    firsts = nodes.where("n > 0").groupBy("key").agg(row, F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("doc_id"))
    firsts = materialize(firsts.select("key", "n", "copies", "doc_id", "row.id", "row.hash"), "sets")

    sorted_postings = _postings(docs, width, t, common).repartition("shingle").sortWithinPartitions("shingle", "key")
    lists = materialize(sorted_postings.mapInArrow(_in_lists, "shingle bigint, key bigint"), "lists")
    p, q = t.numerator, t.denominator
    smallest = F.floor((p * F.col("n") + (q - 1)) / q)  # of a partner
    alive = lists.groupBy("key").count().join(firsts, "key").withColumn("low", _shared(smallest, t)).where("count >= low")
    alive = materialize(alive.select("key", "n", "copies", "id", "hash", "low", _shared(F.col("n"), t).alias("l")), "alive")
    texts = packed(docs).join(alive.select("key", "id", "hash").hint("merge"), ["id", "hash"]).select("key", "packed")
    texts = materialize(texts, "texts")

    lists = lists.join(alive.select("key", "l", "low"), "key")
    leads = lists.groupBy("shingle").agg(F.min(F.struct("key", "l")).alias("lead"), F.count(F.lit(1)).alias("sets")).where("sets > 1")
    lists = lists.join(leads, "shingle").select("shingle", "key", "l", "low", "sets", F.col("lead.key").alias("lead"), F.col("lead.l").alias("lead_l"))
    lists = materialize(lists, "lists")
    stars = lists.where("key <> lead").groupBy("lead", "key", F.least("l", "lead_l").alias("l")).agg(F.count(F.lit(1)).alias("shared"))
    of = components(stars.where("shared >= l").select(F.col("lead").alias("a"), F.col("key").alias("b")))
    of = of.select(F.col("id").alias("key"), "root")
    members = materialize(alive.join(of, "key", "left").select("key", "n", "copies", F.coalesce("root", "key").alias("block")), "members")
    chunks = F.ceil(F.greatest(F.count(F.lit(1)) / CHUNK_DOCS, F.sum("n") / CHUNK_SHINGLES)).alias("chunks")
    families = materialize(members.groupBy("block").agg(F.count(F.lit(1)).alias("size"), chunks), "families")

    # of a set's listed shingles, all but low - 1 of the longest lists: two linked sets share one of these
    of_set = Window.partitionBy("key")
    rare = lists.withColumn("at", F.row_number().over(of_set.orderBy("sets", "shingle"))).withColumn("all", F.count(F.lit(1)).over(of_set))
    rare = rare.where("at <= all - low + 1").select("shingle", "key")
    met = rare.join(members.select("key", "block"), "key").select("shingle", "block").distinct().join(families.select("block", "size"), "block")
    met = materialize(met, "met")
    small, large = (met.select("shingle", F.struct("size", "block").alias(side)) for side in ("small", "large"))
    visits = small.join(large, "shingle").where("small < large").select("small.block", F.col("large.block").alias("host")).distinct()
    visitors = materialize(visits, "visits").join(members.select("block", "key", "copies"), "block").drop("block")
    visitors = materialize(_dealt(visitors.withColumnRenamed("host", "block"), "block", CHUNK_DOCS), "visitors")

    homes = members.join(families.select("block", "size", "chunks"), "block")
    homes = homes.withColumn("mine", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))
    columns = ["block", "kind", "i", "j", "key", "copies", "other"]
    own = homes.where("size > 1").select("block", "key", "copies", "mine", _each("chunks").alias("with"))
    among = own.select(
        "block", F.lit(0).alias("kind"), F.least("mine", "with").alias("i"), F.greatest("mine", "with").alias("j"),
        "key", "copies", (F.col("mine") > F.col("with")).alias("other"),
    )
    guests = visitors.withColumnRenamed("chunks", "parts").join(families.select("block", "chunks"), "block")
    guests = guests.select("block", F.lit(1).alias("kind"), _each("chunks").alias("i"), F.col("chunk").alias("j"), "key", "copies", F.lit(True).alias("other"))
    hosts = homes.join(visitors.select("block", F.col("chunks").alias("parts")).distinct(), "block")
    hosts = hosts.select("block", F.lit(1).alias("kind"), F.col("mine").alias("i"), _each("parts").alias("j"), "key", "copies", F.lit(False).alias("other"))
    asked = among.select(*columns).unionAll(hosts.select(*columns)).unionAll(guests.select(*columns))
    links = materialize(_searched(asked, texts, width, t), "links")

    joined = components(links.where("n IS NULL").select("a", "b"))
    # two sets are searched against each other in one group only, so the sum counts no link twice
    ends = links.where("n IS NOT NULL").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n_links"))
    of_key = firsts.select("key", "copies", "doc_id").join(joined.select(F.col("id").alias("key"), "root"), "key", "left").join(ends, "key", "left")
    of_key = of_key.withColumn("root", F.coalesce("root", "key"))
    lowest = of_key.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    n_links = F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1
    named = materialize(of_key.join(lowest, "root").select("key", "root", "component_id", n_links.alias("n_links")), "named")
    out = nodes.join(named, "key", "left")
    zero = F.when(F.col("n") == 0, F.lit(0).cast("long")).otherwise(F.col("n_links"))
    return out.select("doc_id", "hash", "n", F.coalesce("root", F.lit(0).cast("long")).alias("root"), "component_id", zero.alias("n_links"))
