"""Guards, thresholds and winners judged in blocks of vectors, against tables of pairs."""

import random

import pytest
from pyspark.sql import functions as F

from citegrain.functions import text as T
from citegrain.operators import anchors, reuse
from citegrain.operators.retrieval import cosine_block_join
from citegrain.plans import catalog

WORDS = "solar panel price roof best worst not 3.11 3.12 7 vs versus battery don't a the cost".split()


def rows(spark, seed: int, n: int):
    """Vectors of few values, so that similarities tie, with odd questions, buckets, lengths and times."""
    rng = random.Random(seed)
    told = lambda: rng.choice([None, "", "  ", "?!", "The a", "solar panel price"]) if rng.random() < 0.2 else " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 7)))
    vector = lambda: rng.choice([None, [], [0.5]]) if rng.random() < 0.1 else [rng.choice([0.0, 0.125, 0.25, 0.375, 0.5]) for _ in range(4)]
    made = [(i, rng.choice(["a", "a", "b", None]), vector(), told(), rng.choice([1000, 1100, None]), i % 50, rng.choice([900, 1000, None]), rng.choice([True, False, None])) for i in range(n)]
    return spark.createDataFrame(made, "vec_id bigint, bucket string, e array<double>, question string, now bigint, key bigint, t bigint, time_sensitive boolean")


def sides(spark, n: int = 240):
    both = rows(spark, 5, n)
    answers = spark.createDataFrame([(k, " " if k % 7 == 2 else "told") for k in range(50) if k % 5], "key bigint, answer string")
    return both.where("vec_id % 3 = 0").select("vec_id", "bucket", "e", "question", "now"), both.where("vec_id % 3 <> 0").drop("now"), answers


@pytest.mark.parametrize("block", [7, 2048])
def test_sweep_in_blocks_equals_that_of_pairs(spark, block):
    lookups, index, _ = sides(spark)
    grid = [0.1, 0.25, 0.40625, 9.0]
    want = reuse.threshold_sweep(reuse.semantic_candidates(lookups, index, 0.1), grid).collect()
    assert len(want) == 3 and all(r.accepted and r.rejected for r in want)
    assert sorted(map(tuple, reuse.sweep_in_blocks(lookups, index, grid, block=block).collect())) == sorted(map(tuple, want))
    assert reuse.sweep_in_blocks(lookups.limit(0), index, grid).count() == 0


def test_traits_reject_what_the_reason_does(spark):
    import pyarrow as pa

    from citegrain.operators.guards import Guard

    questions = rows(spark, 6, 150).select("vec_id", "question")
    told = questions.select("vec_id", T.question_traits(F.col("question")).alias("x")).select("vec_id", "x.*").orderBy("vec_id").toArrow()
    for least in (0.0, 0.3, 1.0):
        pairs = questions.alias("x").join(questions.alias("y")).select("x.vec_id", F.col("y.vec_id").alias("other"), T.rejection_reason(F.col("x.question"), F.col("y.question"), least).isNull().alias("ok")).toArrow()
        q, c = (pairs.column(n).to_numpy() for n in ("vec_id", "other"))
        assert (Guard(told, told, least).allows(q, c) == pairs.column("ok").to_numpy()).all()
    empty = pa.table({n: told.column(n).slice(0, 0) for n in told.column_names})
    assert len(Guard(empty, told, 0.3).allows(q[:0], c[:0])) == 0


def test_sweep_makes_no_table_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(reuse, "semantic_candidates", None)
    monkeypatch.setattr(T, "rejection_reason", None)  # the guards' texts are of pairs
    assert catalog.QUERIES["threshold_sweep"](spark, "/root/testdata/sf0.001").count() == 4


def test_similarity_rounds_halves_away_from_zero(spark):
    one = lambda i, x: spark.createDataFrame([(i, 1, [x])], "vec_id bigint, bucket int, e array<double>")
    assert [r.similarity for r in cosine_block_join(one(1, 0.125), one(2, 0.125), 0.01563).collect()] == [0.01563]
    assert [r.similarity for r in cosine_block_join(one(1, 0.125), one(2, -0.125), -1.0).collect()] == [-0.01563]


@pytest.mark.parametrize("block", [7, 2048])
def test_winners_in_blocks_equal_those_of_pairs(spark, block):
    lookups, index, answers = sides(spark)
    want = sorted(map(tuple, reuse._tried(reuse.semantic_candidates(lookups, index, 0.2, max_age_s=150), answers).collect()))
    assert {w is None for _, w, _ in want} == {True, False} and any(w and n for _, w, n in want) and any(n and not w for _, w, n in want)
    got = reuse.tried_in_blocks(lookups, index, answers, 0.2, max_age_s=150, block=block)
    assert sorted(map(tuple, got.collect())) == want
    assert sorted(map(tuple, reuse.won(got).collect())) == [(q, *w, n) for q, w, n in want if w]
    assert reuse.tried_in_blocks(lookups, index.limit(0), answers).count() == 0


def test_reuse_makes_no_table_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(reuse, "semantic_candidates", None)
    monkeypatch.setattr(T, "rejection_reason", None)
    assert catalog.QUERIES["semantic_reuse"](spark, "/root/testdata/sf0.01").count() == 1


@pytest.mark.parametrize("most", [0, 4096])
def test_counts_equal_those_of_attribution(spark, monkeypatch, most):
    from datetime import datetime, timedelta

    monkeypatch.setattr(anchors, "FOLDED", most)
    rng = random.Random(9)
    at = lambda: None if rng.random() < 0.03 else datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(60) * 400)  # noqa: E731 - many at one time
    rows = [(rng.choice(["a", "a", "b", None]), i, at(), rng.choice([True, False, None]), rng.choice([True, False, False, None])) for i in range(500)]
    df = spark.createDataFrame(rows, "query string, event_id bigint, ts timestamp, time_sensitive boolean, cacheable boolean").repartition(3)
    kinds = {r.kind: r["count"] for r in reuse.reuse_attribution(df).groupBy("kind").count().collect()}
    assert kinds["hit"] > 100 and kinds["miss"] > 50
    assert tuple(reuse.reuse_counts(df).first()) == (kinds["hit"], kinds["miss"])
    assert tuple(reuse.reuse_counts(df.limit(0)).first()) == (0, 0)


def test_stats_number_no_requests(spark, monkeypatch):
    monkeypatch.setattr(reuse, "reuse_attribution", None)
    monkeypatch.setattr(reuse, "semantic_candidates", None)
    row = catalog.QUERIES["cache_stats"](spark, "/root/testdata/sf0.01").first()
    assert row.hits + row.misses == 10_000 and row.semantic_hits == 1
