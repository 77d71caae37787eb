"""Column functions and operators on small inputs."""

import pytest
from pyspark.sql import functions as F

from citegrain.functions import text as T
from citegrain.operators import citations, evals, passages, reuse
from citegrain.sources import ingest


def one(spark, column, **values):
    names = ", ".join(f"{k} {'string' if not isinstance(v, int) else 'bigint'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("x")).first().x


@pytest.mark.parametrize("query, candidate, reason", [
    ("best laptops", "worst laptops", "different polarity (best, worst)"),
    ("python 3.11 release", "python 3.12 release", "different numbers (3.11, 3.12)"),
    ("alpha vs beta speed", "beta vs alpha speed", "comparison asked in the opposite order"),
    ("how tall is everest", "when did rome fall", "low word overlap (0.00 < 0.30)"),
    ("", "anything", "empty question"), ("What is Spark?", "what is spark", None), ("a vs b", "laptop battery", "low word overlap (0.00 < 0.30)"),
])
def test_rejection_reason(spark, query, candidate, reason):
    assert one(spark, T.rejection_reason(F.col("a"), F.col("b")), a=query, b=candidate) == reason


@pytest.mark.parametrize("text, markers", [("a [1] b [07] [1]", [1, 7, 1]), ("none", []), (None, []), ("[0] [99]", [0, 99])])
def test_citation_markers(spark, text, markers):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(T.citation_markers(F.col("t")).alias("x")).first().x == markers


@pytest.mark.parametrize("line, kind", [("", "blank"), ("# Title", "heading"), ("| --- | :--: |", "separator"), ("| a | b |", "row"), ("- item", "item"), ("2. item", "item"), ("plain", "prose")])
def test_line_class(spark, line, kind):
    assert one(spark, T.line_class(F.col("a")), a=line) == kind


def test_unclosed_fence_hides_the_rest(spark):
    df = spark.createDataFrame([(1, "one\n```\ncode\n```\ntwo\n```\nthree")], "turn_id bigint, answer string")
    assert [r.line for r in evals.markdown_lines(df).orderBy("i").collect()] == ["one", "two"]


def test_claims_of_table_list_and_prose(spark):
    long = "A sentence that is certainly long enough to be a claim [1]."
    answer = f"# Head\n{long} Another sentence that is long enough to count as well.\n- {long}\n- short\n| A | B |\n| --- | --- |\n| x1 | y |\n"
    df = spark.createDataFrame([(1, answer)], "turn_id bigint, answer string")
    units = evals.claim_units(evals.markdown_lines(df))
    assert units.count() == 4
    assert evals.citation_coverage(units).first()[1:] == (2, 4)


def test_number_sources_caps_and_skips(spark):
    rows = [(1, p, f"u{p % 10}" if p != 3 else "", "text" if p != 4 else "") for p in range(1, 31)]
    numbered = citations.number_sources(spark.createDataFrame(rows, "turn_id bigint, position bigint, source_url string, text string")).orderBy("position").collect()
    assert len(numbered) == 12 and max(r.idx for r in numbered) == 8 and {r.position for r in numbered}.isdisjoint({3, 4})


def test_audit_of_nulls_and_no_sources(spark):
    rows = citations.citation_audit(spark.createDataFrame([(1, None, 3), (2, "x [4] [1] [1]", 3), (3, "x [4]", 0)], "turn_id bigint, answer string, n_sources bigint")).orderBy("turn_id").collect()
    assert [(r.n_markers, r.n_valid_distinct, r.invalid) for r in rows] == [(0, 0, []), (3, 1, [4]), (1, 0, [])]


@pytest.mark.parametrize("text, n", [("", 0), ("   ", 0), ("short", 1), ("x" * 500, 1), ("word " * 400, 4), ("y" * 1300, 3)])
def test_chunks(spark, text, n):
    chunks = passages.passages(text, 500, 50)
    assert len(chunks) == n
    assert all(w in " ".join(chunks) for w in text.split()) or len(text.split()) == 1


def test_chunks_keep_order_and_overlap():
    chunks = passages.passages("\n\n".join(f"Paragraph {i} says something of its own here." for i in range(20)), 100, 10)
    assert all(b.startswith(a[-10:].strip()[:3]) or a[-10:] in b for a, b in zip(chunks, chunks[1:]))


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [round(r.x, 6) for r in df.select(reuse.cosine(reuse.normalize_vector(F.col("a")), reuse.normalize_vector(F.col("b"))).alias("x")).collect()] == [1.0, 0.0, 0.0]


def test_files_of_any_kind(spark):
    rows = [("/x/a.txt", 3, b"ab\xff"), ("/x/b.pdf", 1, b"x"), ("/x/c.md", 2, b"  "), ("/x/d.docx", 3, b"zip"), ("/x/e.txt", 20000, b"z" * 20000)]
    got = {r.name: r for r in ingest.extract_files(spark.createDataFrame(rows, "path string, length bigint, content binary")).collect()}
    assert got["a.txt"].text.startswith("ab") and got["b.pdf"].error == "unsupported type .pdf" and got["c.md"].error == "no text"
    assert got["d.docx"].error == "unreadable file" and got["e.txt"].text.endswith("[...truncated at 12000 chars]")


def test_page_text_drops_scripts_and_keeps_tables():
    html = "<html><script>x()</script><nav>menu</nav><p>" + "Body text of the page. " * 5 + "</p><table><tr><td>cell</td></tr></table></html>"
    text = ingest.main_text(html)
    assert "cell" in text and "menu" not in text and "x()" not in text and ingest.main_text("<p>short</p>") is None


def test_summary_of_nothing(spark):
    schema = "turn_id bigint, query string, answer string, n_sources bigint, mode string, declared string, expected string, must_mention array<string>, ranked_chunks bigint, top_score double, latency_ms bigint, total_tokens bigint, cost_usd double, error string"
    row = evals.summarize(evals.score_runs(spark.createDataFrame([], schema))).first()
    assert row.queries == 0 and row.mean_coverage == 0.0


def test_similar_answers_are_tried_best_first(spark):
    from citegrain.operators import reuse

    lookups = spark.createDataFrame([(1, "b", [1.0, 0.0], "best solar panel price", 1000), (2, None, [1.0, 0.0], "best solar panel price", 1000), (3, "b", None, "x", 1000)], "vec_id bigint, bucket string, e array<double>, question string, now bigint")
    index = [
        (10, "b", [1.0, 0.0], "worst solar panel price", 10, 1000, False),  # a guard rejects it
        (11, "b", [0.99, 0.1], "best solar panel price today", 11, 879, True),  # 121 s old
        (12, "b", [0.98, 0.1], "best solar panel price now", 12, 1000, True),  # its answer is blank
        (13, "b", [0.97, 0.1], "best solar panel price here", 13, 1000, None),
        (14, "b", [0.96, 0.1], "worst panel", 14, 1000, False),  # below the winner
        (15, "c", [1.0, 0.0], "best solar panel price", 15, 1000, False),
        (16, "b", [1.0], "best solar panel price", 16, 1000, False),  # of another length
    ]
    index = spark.createDataFrame(index, "vec_id bigint, bucket string, e array<double>, question string, key bigint, t bigint, time_sensitive boolean")
    answers = spark.createDataFrame([(k, " " if k == 12 else "told") for k in (10, 11, 12, 13, 13, 14)], "key bigint, answer string")
    candidates = reuse.semantic_candidates(lookups, index, 0.9)
    assert [tuple(r) for r in reuse.semantic_reuse(candidates, answers).collect()] == [(1, 13, 0.97, "best solar panel price here", 1)]
    attribution = spark.createDataFrame([("hit",), ("miss",), ("miss",)], "kind string")
    assert tuple(reuse.cache_stats(attribution, candidates, answers).first()) == (1, 2, 1, 1, 0.333, 0.5)
    assert tuple(reuse.cache_stats(attribution.limit(0), candidates.limit(0), answers.limit(0)).first()) == (0, 0, 0, 0, 0.0, 0.0)


def test_claims_in_rows_equal_those_of_line_tables(spark):
    import random

    from citegrain.functions import answers as A

    rng = random.Random(4)
    long = "A sentence that is certainly long enough to be one claim."
    pieces = [long, f"{long} And another sentence of more than forty-five characters [2]!", "short.", "", "  ", f"- {long} [1]", "3) " + long, "* x", "| A | B |", "| --- | :-: |", "|x|", "| [1] long | y |", "# Head", "```", "``` py", "---", "|---|", "plain\x0bbroken " + long]
    rows = [(i, "\n".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))) for i in range(300)] + [(900, None), (901, "\n"), (902, "| A |\n|---|---|\n| B1 |")]
    df = spark.createDataFrame(rows, "turn_id bigint, answer string")
    lines = evals.markdown_lines(df)
    units = evals.claim_units(lines)
    shown = A.with_visible_lines(df)
    assert sorted((r.turn_id, r.u) for r in shown.select("turn_id", F.explode(A.claims(F.col("visible"))).alias("u")).collect()) == sorted((r.turn_id, r.unit) for r in units.collect())
    counted = {r.turn_id: (r.cited_units, r.total_units) for r in evals.citation_coverage(units).collect()}
    built = {r.turn_id: tuple(r)[1:] for r in evals.structure(lines).collect()}
    for r in A.with_structure(df).collect():
        assert (r.cited_units, r.total_units) == counted.get(r.turn_id, (0, 0))
        assert (r.list_items, r.ordered_items, r.table_columns, r.has_table) == built.get(r.turn_id, (0, 0, 0, False))


def test_models_that_fail_embed_nothing(spark):
    import numpy as np

    from citegrain.operators import embed

    def picky():
        def model(texts):
            if any("bad" in t for t in texts):
                raise ValueError("bad")
            return np.array([[3.0, 4.0]] * len(texts))

        return model

    def broken():
        raise OSError("no model")

    df = spark.createDataFrame([(1, "good \n one"), (2, "good one"), (3, "bad"), (4, "  "), (5, None)], "q_id bigint, question string").coalesce(1)
    assert {r.q_id: r.e for r in embed.embed_questions(df, picky).collect()} == {1: [0.6, 0.8], 2: [0.6, 0.8], 3: None, 4: None, 5: None}
    assert {r.e for r in embed.embed_questions(df, broken).collect()} == {None}
