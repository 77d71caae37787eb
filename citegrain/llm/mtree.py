"""Exact top-k inner products with a paged M-tree and best-first search.

Inner products become distances: with every vector x lengthened by sqrt(M^2 - |x|^2), M the largest
norm, and every query by 0, the squared distance is |q|^2 + M^2 - 2 q.x, so the nearest are those of
the highest product. The root node holds pivots, chosen farthest first from a bounded,
hash-ordered sample, each with the smallest and largest distance of its vectors; below it lie pages of bounded size (several under a
pivot of many vectors), and in a page leaves that store their covering radius and each entry's
distance to its parent. Every query first searches the page of lowest bound, which gives it a k-th
score; it then goes only to the pages whose bound can still beat that. Inside a page leaves come in
the order of their bounds, entries are skipped by |d(q, parent) - d(x, parent)| alone, and leaves whole
by their radius. Spark shuffles the table by page once a round, whatever the number of queries: a page
is held while the queries that need it stream past. A window merges each query's finds.

Bounds are kept in floating point with a margin; ranks are by the exact integer products (a product
beyond 64 bits counts as the nearest 64-bit integer). Vectors that are null, or hold null or non-finite
components, take no part; shorter vectors count as followed by zeros. Ties go to the smaller id;
repeated rows are candidates each, and query rows of one id share one list of k. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Pivots of the root, vectors they are chosen from, components of a page's vectors, entries of a leaf.
PIVOTS, SAMPLE, PAGE, LEAF = 256, 4096, 1 << 20, 128
FOUND = "query_id bigint, vec_id bigint, score bigint"


def integer_vector(embedding: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component, x as double; null if the vector or a component is null or not finite."""
    wide = embedding.cast("array<double>")
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(wide, lambda x: F.floor(x * scale)))


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """Rows of integers as doubles, filled with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), dims))
    out[np.arange(dims) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


class Page:
    """A two-level M-tree: leaves of entries around routing vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, lift: float):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        self.lifted = np.sqrt(np.maximum(lift - (vectors * vectors).sum(1), 0))
        full = np.column_stack([vectors, self.lifted])
        n_leaves = -(-len(ids) // LEAF)
        routing = full[np.linspace(0, len(ids) - 1, n_leaves).astype(int)]
        square = lambda a, b: np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0)
        to_routing = np.sqrt(square(full, routing))
        leaf = to_routing.argmin(1)
        parent = to_routing[np.arange(len(ids)), leaf]
        # entries of a leaf lie together, by distance from the parent, so bounds cut out a run of them
        at = np.lexsort((parent, leaf))
        self.ids, self.vectors, self.parent = ids[at], vectors[at], parent[at]
        self.begins = np.searchsorted(leaf[at], np.arange(n_leaves + 1))
        self.routing = routing
        self.radius = np.array([self.parent[b - 1] if b > a else -1.0 for a, b in zip(self.begins[:-1], self.begins[1:])])


def search_page(page: Page, queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, k: int, lift: float) -> tuple[list, list, list, np.ndarray]:
    """(query ids, vector ids, scores) of each query's best k in the page that reach its floor (nan: none), and the
    products computed for each query."""
    norm = (queries * queries).sum(1)
    routing = page.routing
    d_parent = np.sqrt(np.maximum(norm[:, None] + lift - 2 * queries @ routing[:, :-1].T, 0))
    bound = np.where(page.radius >= 0, np.maximum(d_parent - page.radius, 0), np.inf)
    out_q, out_v, out_s, computed = [], [], [], np.zeros(len(queries), np.int64)
    exact = float(np.abs(page.vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, queries.shape[1]) < 2.0**53
    reach = _reach(norm, floors, lift)
    for q in range(len(queries)):
        ids, scores, kth = np.empty(0, np.int64), np.empty(0), reach[q]
        margin = _margin(norm[q], lift)
        for leaf in np.argsort(bound[q], kind="stable"):
            if bound[q, leaf] > kth + margin:
                break
            a, b = page.begins[leaf], page.begins[leaf + 1]
            if kth < np.inf:  # the stored parent distances leave a run of entries
                low, high = d_parent[q, leaf] - kth - margin, d_parent[q, leaf] + kth + margin
                a, b = a + np.searchsorted(page.parent[a:b], low), a + np.searchsorted(page.parent[a:b], high, "right")
            if b <= a:
                continue
            new_ids = page.ids[a:b]
            if exact:
                new = page.vectors[a:b] @ queries[q]
            else:
                whole = [sum(int(x) * int(y) for x, y in zip(v, queries[q])) for v in page.vectors[a:b]]
                new = np.array([max(-(2**63), min(2**63 - 1, x)) for x in whole], object)
            computed[q] += b - a
            own = new_ids != query_ids[q]
            if floors[q] == floors[q]:
                own &= (new >= floors[q] - 1e-15 * abs(floors[q])).astype(bool)
            ids, scores = np.concatenate([ids, new_ids[own]]), np.concatenate([scores, new[own]])
            if len(ids) > k:
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
            if len(ids) == k:
                kth = min(kth, math.sqrt(max(0.0, norm[q] + lift - 2 * float(min(scores)))))
        out_q.append(np.full(len(ids), query_ids[q]))
        out_v.append(ids)
        out_s.append(scores)
    return out_q, out_v, out_s, computed


def _margin(norm: np.ndarray | float, lift: float) -> np.ndarray | float:
    """What rounding may move a distance by, with room to spare."""
    return 1e-6 * (1 + np.sqrt(lift + norm))


def _reach(norm: np.ndarray, floors: np.ndarray, lift: float) -> np.ndarray:
    """The distance at which a query's product is its floor; infinite without one."""
    return np.where(np.isnan(floors), np.inf, np.sqrt(np.maximum(norm + lift - 2 * np.nan_to_num(floors), 0)))


def farthest_first(sample: np.ndarray, lift: float, n: int) -> np.ndarray:
    """At most n different rows of the sample, each the farthest from those before it."""
    lifted = np.sqrt(np.maximum(lift - (sample * sample).sum(1), 0))
    far, chosen = np.full(len(sample), np.inf), []
    while len(chosen) < min(n, len(sample)) and (not chosen or far.max() > _margin(0.0, lift)):
        i = int(far.argmax())
        chosen.append(i)
        products = sample @ sample[i] + lifted * lifted[i]
        far = np.minimum(far, np.sqrt(np.maximum(2 * (lift - products), 0)))
        far[i] = 0
    return sample[chosen]


class Root:
    """The top node: pivots, the ring of distances that holds each one's vectors, and its pages."""

    def __init__(self, pivots: np.ndarray, lift: float):
        self.pivots, self.lift = pivots, lift
        self.lifted = np.sqrt(np.maximum(lift - (pivots * pivots).sum(1), 0))
        self.low, self.high = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
        self.pages, self.base = np.zeros(len(pivots), np.int64), np.zeros(len(pivots), np.int64)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's pivot and its distance."""
        lifted = np.sqrt(np.maximum(self.lift - (vectors * vectors).sum(1), 0))
        products = vectors @ self.pivots.T + lifted[:, None] * self.lifted
        near = products.argmax(1)
        return near, np.sqrt(np.maximum(2 * (self.lift - products[np.arange(len(near)), near]), 0))

    def learn(self, facts: list, page_rows: int) -> None:
        """Take (pivot, vectors, smallest, largest distance) of each pivot that has any."""
        for pivot, n, low, high in facts:
            self.pages[pivot], self.low[pivot], self.high[pivot] = -(-n // page_rows), low, high
        self.base = np.cumsum(self.pages) - self.pages

    def route(self, ids: np.ndarray, queries: np.ndarray, floors: np.ndarray | None) -> Iterator[tuple[int, np.ndarray]]:
        """(query's place, pages): the best page where there are no floors yet, else all others that can reach them."""
        norm = (queries * queries).sum(1)
        d = np.sqrt(np.maximum(norm[:, None] + self.lift - 2 * queries @ self.pivots.T, 0))
        bound = np.where(self.pages > 0, np.maximum(np.maximum(d - self.high, self.low - d), 0), np.inf)
        for q in range(len(queries)):
            best = np.lexsort((d[q], bound[q]))[0]
            first = self.base[best] + ids[q] % self.pages[best]
            if floors is None:
                yield q, np.array([first])
                continue
            within = np.flatnonzero((self.pages > 0) & (bound[q] <= _reach(norm[q], floors[q], self.lift) + _margin(norm[q], self.lift)))
            pages = np.concatenate([np.arange(self.base[p], self.base[p] + self.pages[p]) for p in within] or [np.empty(0, np.int64)])
            yield q, pages[pages != first]


def _search(vectors: DataFrame, is_query: Column, k: int, id_col: str, embedding_col: str, count: bool) -> DataFrame:
    """(query_id, vec_id, score) of both rounds; if `count`, a row of null vec_id with the products computed for each
    query and page."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), integer_vector(F.col(embedding_col)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = materialize(rows.where("v IS NOT NULL AND vec_id IS NOT NULL"), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    facts = rows.agg(F.max(square), F.max(F.size("v"))).first()
    lift, dims = facts[0] or 0.0, max(1, facts[1] or 0)
    page_rows = max(LEAF, PAGE // dims)
    sample = _matrix(rows.select("v").orderBy(F.xxhash64("v"), "vec_id").limit(SAMPLE).toArrow().column("v"), dims)
    root = Root(farthest_first(sample, lift, PIVOTS), lift)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pivot, far = root.nearest(_matrix(batch.column("v"), dims))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(pivot, pa.int64()), pa.array(far, pa.float64())], ["vec_id", "v", "pivot", "far"])

    dealt = materialize(rows.select("vec_id", "v").mapInArrow(deal, "vec_id bigint, v array<bigint>, pivot bigint, far double"), "dealt")
    # at most PIVOTS rows
    root.learn(dealt.groupBy("pivot").agg(F.count(F.lit(1)), F.min("far"), F.max("far")).collect(), page_rows)
    nodes = vectors.sparkSession.createDataFrame([(i, int(b), int(n)) for i, (b, n) in enumerate(zip(root.base, root.pages))], "pivot bigint, base bigint, pages bigint")
    # rows alike in all are told apart by nothing, so a random number of a fixed seed deals them out
    page = F.col("base") + F.when(F.col("pages") > 1, F.pmod(F.xxhash64("vec_id", F.rand(7)), F.col("pages"))).otherwise(0)
    entries = dealt.join(F.broadcast(nodes), "pivot").select(page.alias("page"), F.lit(False).alias("q"), "vec_id", "v", F.lit(None).cast("double").alias("floor"))
    entries = materialize(entries, "pages")

    def ask(batches: Iterator[pa.RecordBatch], again: bool) -> Iterator[pa.RecordBatch]:
        most = max(1, PAGE // dims)
        for batch in batches:
            for part in (batch.slice(a, most) for a in range(0, batch.num_rows, most)):
                floors = part.column("floor").cast(pa.float64()).to_numpy(zero_copy_only=False) if again else None
                for q, pages in root.route(part.column("vec_id").to_numpy(), _matrix(part.column("v"), dims), floors):
                    for a in range(0, len(pages), most):
                        n = len(pages[a : a + most])
                        same = part.slice(q, 1).take(pa.array(np.zeros(n, np.int64)))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(pages[a : a + most], pa.int64()), pa.array(np.ones(n, bool)), same.column("vec_id"), same.column("v"), same.column("floor")],
                            ["page", "q", "vec_id", "v", "floor"],
                        )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, node = None, [], None
        for batch in batches:
            pages, asks = batch.column("page").to_numpy(), batch.column("q").to_numpy(zero_copy_only=False)
            cuts = (np.flatnonzero((np.diff(pages) != 0) | (asks[1:] != asks[:-1])) + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                if a == b:
                    continue
                if pages[a] != current:
                    current, held, node = pages[a], [], None
                run = batch.slice(a, b - a)
                ids, m = run.column("vec_id").to_numpy(), _matrix(run.column("v"), dims)
                if not asks[a]:
                    held.append((ids, m))
                    continue
                if node is None:
                    if not held:
                        continue
                    node, held = Page(np.concatenate([i for i, _ in held]), np.concatenate([x for _, x in held]), lift), []
                q, v, s, computed = search_page(node, m, ids, run.column("floor").to_numpy(zero_copy_only=False), k, lift)
                q, v, s = np.concatenate(q).tolist(), np.concatenate(v).tolist(), [int(x) for x in np.concatenate(s)]
                if count:
                    q, v, s = q + ids.tolist(), v + [None] * len(ids), s + computed.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (q, v, s)], ["query_id", "vec_id", "score"])

    def round_of(queries: DataFrame, again: bool) -> DataFrame:
        asked = queries.mapInArrow(lambda b: ask(b, again), "page bigint, q boolean, vec_id bigint, v array<bigint>, floor double")
        return entries.unionByName(asked).repartition("page").sortWithinPartitions("page", "q", "vec_id").mapInArrow(search, FOUND)

    queries = rows.where("q").select("vec_id", "v", F.lit(None).cast("double").alias("floor"))
    if not len(root.pivots):
        return vectors.sparkSession.createDataFrame([], FOUND)
    found = materialize(round_of(queries, False), "found")
    floors = best(found.where("vec_id IS NOT NULL"), k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("floor"))
    return found.unionByName(round_of(queries.drop("floor").join(floors, "vec_id", "left").select("vec_id", "v", "floor"), True))


def best(found: DataFrame, k: int) -> DataFrame:
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", embedding_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k highest products with the other rows."""
    return best(_search(vectors, is_query, k, id_col, embedding_col, False), k)


def products_computed(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", embedding_col: str = "embedding") -> DataFrame:
    """(query_id, products): how many products the search computed for each query id."""
    found = _search(vectors, is_query, k, id_col, embedding_col, True)
    return found.where("vec_id IS NULL").groupBy("query_id").agg(F.sum("score").alias("products"))
