"""Chains of anchors, exact reuse, turns in streams, fences, passages and baselines against brute force."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from citegrain.functions import markdown as M
from citegrain.operators import anchors, answer_store, evals, markdown, passages, reuse, trace
from citegrain.storage import scratch
from citegrain.streaming import events, turns

T0 = datetime(2024, 3, 30, 22)


def plan_of(df):
    return df._jdf.queryExecution().toString()


def log(seed, n, keys, seconds):
    rng = random.Random(seed)
    rows = [(rng.choice(keys), i, T0 + timedelta(seconds=rng.randrange(seconds)), rng.choice([True, False, None]), rng.choice([True, True, False, None])) for i in range(n)]
    return rows + [("a", n, None, True, True), (None, n + 1, None, False, True)]


def by_key(rows):
    ordered = sorted((r for r in rows if r[2]), key=lambda r: (str(r[0]), r[2], r[1]))
    return [[r for r in ordered if r[0] == k] for k in {r[0] for r in ordered}]


@pytest.mark.parametrize("most", [0, 80, 4096])
@pytest.mark.parametrize("keys, seconds", [("ab", 400), ("a", 90_000), ([None, "x", "y", "z"], 5000)])
def test_windows_equal_a_loop(spark, monkeypatch, keys, seconds, most):
    monkeypatch.setattr(anchors, "FOLDED", most)
    rows = log(1, 300, keys, seconds)
    df = spark.createDataFrame(rows, "user_id string, event_id bigint, ts timestamp_ntz, time_sensitive boolean, cacheable boolean").repartition(3)
    want = {r[1]: (r[0], None, None, None) for r in rows}
    for mine in by_key(rows):
        start = n = None
        for key, event, ts, *_ in mine:
            if start is None or ts >= start + timedelta(seconds=100):
                start, n = ts, 0
            n += 1
            want[event] = (key, start, n, n > 3)
    got = reuse.anchored_windows(df, duration_s=100, limit=3)
    assert {r.event_id: (r.user_id, r.window_start, r.n, r.exceeded) for r in got.collect()} == want
    assert "InPandas" not in plan_of(got) and "Python" not in plan_of(got)
    assert reuse.anchored_windows(df.limit(0)).count() == 0


@pytest.mark.parametrize("most", [0, 4096])
@pytest.mark.parametrize("keys, seconds", [("ab", 30_000), ("a", 300_000), ([None, "x"], 5000)])
def test_attribution_equals_a_loop(spark, monkeypatch, keys, seconds, most):
    monkeypatch.setattr(anchors, "FOLDED", most)
    rows = log(2, 300, keys, seconds)
    df = spark.createDataFrame(rows, "query string, event_id bigint, ts timestamp, time_sensitive boolean, cacheable boolean").repartition(3)
    want = {r[1]: ("miss", None, None) for r in rows}
    for mine in by_key(rows):
        held = None
        for _, event, ts, sensitive, cacheable in mine:
            if held and ts < held[1] + timedelta(seconds=held[2]):
                want[event] = ("hit", held[0], int((ts - held[1]).total_seconds()))
            elif cacheable:
                held = event, ts, 21_600 if sensitive is False else 900
    got = reuse.reuse_attribution(df)
    assert {r.event_id: (r.kind, r.stored_event_id, r.age_s) for r in got.collect()} == want
    assert "InPandas" not in plan_of(got) and "Python" not in plan_of(got)


def test_one_key_takes_several_tasks(spark, monkeypatch):
    df = spark.range(20_000).selectExpr("'k' AS user_id", "id AS event_id", "TIMESTAMP_NTZ'2024-01-01' + make_dt_interval(0, 0, 0, CAST(id AS INT)) AS ts")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the rows are too few to need tasks of their own
    try:
        monkeypatch.setattr(anchors, "FOLDED", 100)
        rows = anchors.numbered(anchors.with_ends(df, "user_id", F.lit(True), F.lit(60)))
        sizes = [r.n for r in rows.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()]
        assert len(sizes) == 4 and max(sizes) < 8000
        assert sorted(r.pos for r in anchors.anchors(rows).collect()) == list(range(0, 20_000, 60))
        got = reuse.anchored_windows(df, duration_s=60, limit=10)
        assert [tuple(r) for r in got.groupBy("n").count().where("n IN (1, 20, 60)").orderBy("n").collect()] == [(1, 334), (20, 334), (60, 333)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("hot", [1_000_000, 5])
def test_exact_reuse_equals_a_loop(spark, hot):
    rng = random.Random(5)
    at = lambda: T0 + timedelta(seconds=rng.randrange(200_000))
    stored = [(rng.choice("abc"), i, at(), rng.choice([900, 21_600, 90_000]), rng.choice(["x", "y", " ", None])) for i in range(120)] + [("a", 500, T0, 900, "first"), ("a", 501, T0, 900, "second"), (None, 502, T0, 900, "z"), ("b", 503, None, 900, "z")]
    asked = [(i, rng.choice(["a", "b", "c", "d", None]), at()) for i in range(300)] + [(900, "a", T0), (901, "a", None)]
    name = f"answers_{hot}"
    answer_store.save_answers(spark.createDataFrame(stored, "key string, event_id bigint, ts timestamp_ntz, ttl_s int, answer string"), name)
    requests = spark.createDataFrame(asked, "event_id bigint, key string, ts timestamp_ntz")
    want = {}
    for event, key, ts in asked:
        before = [s for s in stored if s[0] == key and key is not None and ts and s[2] and s[2] <= ts]
        s = max(before, key=lambda s: (s[2], s[1]), default=None)
        hit = s and ts < s[2] + timedelta(seconds=s[3]) and (s[4] or "").strip()
        want[event] = (key, "hit", s[1], s[4], int((ts - s[2]).total_seconds())) if hit else (key, "miss", None, None, None)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = answer_store.exact_reuse(requests, name, hot_requests=hot)
        assert {r.event_id: (r.key, r.kind, r.stored_event_id, r.answer, r.age_s) for r in got.collect()} == want
        assert sum(w[1] == "hit" for w in want.values()) > 20
        if hot > 5:
            plan = got._jdf.queryExecution().executedPlan().toString()
            plan = plan[plan.index("Final Plan") : plan.index("Initial Plan")] if "Initial Plan" in plan else plan
            assert plan.count("Exchange") == 1 and "Bucketed: true" in plan  # the requests alone move
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def turn_log(seed, n_turns):
    """(events, expected): turns with tokens, sources, images, pauses, errors and repeated events."""
    rng = random.Random(seed)
    rows = []
    for turn in range(n_turns):
        kinds = [("token", f'{{"token": "{turn}-{i} "}}') for i in range(rng.randint(1, 6))] + [("images", '{"images": ["a"]}'), ("images", f'{{"images": ["{turn}"]}}'), ("follow_up", '{"suggestions": ["x", "y"]}'), ("trace", '{"t": 1}')]
        kinds += [("sources", f'{{"sources": [{{"idx": 1, "url": "u{rng.randrange(3)}", "title": "t"}}], "replace": {rng.choice(["true", "false"])}}}') for _ in range(3)]
        rng.shuffle(kinds)
        kinds += [("error", "{}")] * (turn % 7 == 3) + [("done", "{}")] * (turn % 5 != 2) + [("token", '{"token": "late"}')] * (turn % 4 == 0)
        pause = rng.randrange(3, 9) if turn % 6 == 1 else 99
        at = T0 + timedelta(seconds=rng.randrange(3000))
        for seq, (kind, payload) in enumerate(kinds):
            at += timedelta(seconds=400 if seq == pause else rng.randint(0, 20))
            rows.append((turn, seq, at, kind, payload))
            if rng.random() < 0.1:
                rows.append((turn, seq, at, kind, payload))
    rng.shuffle(rows)
    return rows


SCHEMA = "turn_id bigint, seq int, ts timestamp, type string, payload string"


def flat(df):
    return sorted((r.turn_id, r.answer, tuple(s.url for s in r.sources), r.images, r.trace, tuple(r.follow_ups or ()), r.error) for r in df.collect())


def brute_turns(rows):
    import json

    out = []
    for turn in {r[0] for r in rows}:
        mine = sorted({r[:5] for r in rows if r[0] == turn}, key=lambda r: r[1])
        times = sorted(r[2] for r in mine)
        stop = next((a for a, b in zip(times, times[1:]) if b - a > timedelta(seconds=300)), None)
        mine = [r for r in mine if stop is None or r[2] <= stop]
        done = next((r[1] for r in mine if r[3] == "done"), None)
        if done is not None:
            mine = [r for r in mine if r[1] <= done]
        finished = done is not None and len(mine) == done + 1
        if any(r[3] == "error" for r in mine):
            continue
        answer, urls, last = "", [], {}
        for _, _, _, kind, payload in mine:
            body = json.loads(payload)
            if kind == "token":
                answer += body["token"]
            elif kind == "sources":
                new = [s["url"] for s in body["sources"]]
                urls = new if body["replace"] else urls + [u for u in new if u not in urls]
            last[kind] = (payload, body)
        images = last.get("images") and json.dumps(last["images"][1]["images"])
        out.append((turn, answer, tuple(urls), images, last["trace"][0] if "trace" in last else None, tuple(last["follow_up"][1]["suggestions"]) if "follow_up" in last else (), None if finished else "timeout"))
    return sorted(out)


def test_batch_turns_equal_a_loop(spark):
    rows = turn_log(4, 60)
    got = flat(turns.fold_turns(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute_turns(rows) and {r[-1] for r in got} == {None, "timeout"}
    still_open = turns.fold_turns(spark.createDataFrame(rows, SCHEMA), until=F.lit(T0))
    assert all(r.error is None or r.turn_id % 6 == 1 for r in still_open.collect())
    assert turns.fold_turns(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shuffled_stream_equals_its_batch_twin(spark):
    """Events out of order over several batches, repeated ones among them; a later event lets the silent turns time out."""
    rows = turn_log(6, 40)
    folder, place = scratch(spark, "log"), scratch(spark, "turns")
    got = None
    for part in range(4):
        more = [(-1, 0, T0 + timedelta(days=30), "phase", "{}")] * (part == 3)
        spark.createDataFrame(rows[part::4] + more, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        got = events.run_available(turns.fold_turns_stream(spark.readStream.schema(SCHEMA).parquet(folder), late="1 day"), place=place)
    want = flat(turns.fold_turns(spark.createDataFrame(rows, SCHEMA)))
    assert flat(got) == want and {"timeout", None} == {r[-1] for r in want}


def brute_states(kinds, any_closes):
    states, s = [0], 0
    for k in kinds:
        s = k if s == 0 else 0 if any_closes or s == k else s
        states.append(s)
    return states


@pytest.mark.parametrize("any_closes", [False, True])
def test_fence_states_of_many_chunks(spark, any_closes, monkeypatch):
    monkeypatch.setattr(M, "CHUNK", 4)
    rng = random.Random(2)
    lists = [[], [1], [1, 2, 1], [2, 1, 1, 2]] + [[rng.choice([1, 2]) for _ in range(n)] for n in (3, 4, 5, 8, 9, 50, 101)]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(lists)], "i int, kinds array<int>")
    for r in df.select("i", M.running_states(F.col("kinds"), any_closes).alias("s")).collect():
        assert r.s == brute_states(lists[r.i], any_closes)


def test_blocks_with_nested_and_unclosed_fences(spark):
    text = "# One **two**\n\n- a [1]\n2. b\n~~~ sh\n```\n**kept**\n~~~\n| A | `B` |\n|---|:-:|\n####### no\n```\nopen\n~~~\n"
    got = [(r.line_no, r.type, r.level, r.text) for r in markdown.markdown_blocks(spark.createDataFrame([(1, text), (2, None), (3, "")], "turn_id bigint, answer string")).orderBy("line_no").collect()]
    assert got == [
        (0, "heading1", 1, "One two"), (1, "blank", None, ""), (2, "bullet", None, "a"), (3, "bullet", None, "b"), (5, "code", None, "```"), (6, "code", None, "**kept**"),
        (8, "table-row", None, "A  |  `B`"), (10, "paragraph", None, "####### no"), (12, "code", None, "open"), (13, "code", None, "~~~"), (14, "code", None, ""),
    ]


def brute_passages(text, size, overlap, level=0):
    """Recursive: split at the first separator that is there, pack, split what is too long, then add overlaps."""
    if len(text) <= size:
        return [text]
    while level < len(passages.SEPARATORS) and passages.SEPARATORS[level] not in text:
        level += 1
    if level == len(passages.SEPARATORS):
        return [text[i : i + size] for i in range(0, len(text), max(1, size - overlap))]
    mark, out, held = passages.SEPARATORS[level], [], ""
    for part in text.split(mark):
        joined = held + mark + part if held else part
        if len(joined) <= size:
            held = joined
            continue
        out += [held] if held else []
        held = ""
        if len(part) > size:
            out += brute_passages(part, size, overlap, level + 1)
        else:
            held = part
    out += [held] if held else []
    return [w if i == 0 or overlap <= 0 else f"{out[i - 1][-overlap:]} {w}" for i, w in enumerate(out)]


def long_texts():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))
    joins = ["\n\n", "\n", ". ", "! ", " ", " ", " ", ", ", "; "]
    made = ["".join(word() + rng.choice(joins) for _ in range(n)) for n in (5, 40, 300, 2000)]
    return [None, "", "  ", "x" * 2000, " \n" + "y" * 900 + "\n", " " * 3000 + "short", "a. " * 700, "\n\n".join(" ".join(word() for _ in range(80)) for _ in range(30)), *made, *(m.replace("\n\n", " ") for m in made)]


@pytest.mark.parametrize("overlap", [0, 10])
def test_passages_of_long_texts_in_parts(spark, overlap):
    texts = long_texts()
    df = spark.createDataFrame([(i % 9, t, f"u{i}", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, url string, chunk_no int")
    got = passages.chunk_corpus(df, size=80, overlap=overlap, keep=("url",), long_chars=100)
    parts = passages.chunk_long_texts(df.where(F.length(F.trim("text")) > 100), "doc_id", 80, overlap, "text", ("url",), task_chars=500)
    want = []
    for i, t in enumerate(texts):
        t = (t or "").strip()
        kept = [t] if t and len(t) <= 80 else [w for w in map(str.strip, brute_passages(t, 80, overlap)) if len(w) > 30]
        want += [(i % 9, k, w, f"u{i}") for k, w in enumerate(kept)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    long = {f"u{i}" for i, t in enumerate(texts) if t and len(t.strip(" ")) > 100}
    assert {r for r in map(tuple, parts.collect())} == {w for w in want if w[3] in long}


def test_table_functions_equal_the_operator(spark):
    df = spark.createDataFrame(list(enumerate(long_texts())), "doc_id bigint, text string").repartition(2)
    passages.register_table_functions(spark)
    got = spark.sql("SELECT d.doc_id, c.chunk_no, c.passage FROM {d} d, LATERAL chunk_passages(d.text, 80, 10) c", d=df)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, passages.chunk_text(df, size=80, overlap=10).collect()))
    whole = spark.sql("SELECT id, chunk_no, passage FROM chunk_table(TABLE(SELECT doc_id, text FROM {d}))", d=df)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, passages.chunk_text(df).collect()))


@pytest.mark.parametrize("name", ["chunk_lateral", "chunk_table", "chunk_long_texts"])
def test_chunk_queries_equal_the_operator(spark, name):
    from citegrain.plans import catalog

    told = lambda df: sorted(map(tuple, df.select("doc_id", "chunk_no", "text").collect()))
    d = "/root/testdata/sf0.001"
    assert told(catalog.QUERIES[name](spark, d)) == told(catalog.QUERIES["chunk_corpus"](spark, d))


def test_passages_of_pages_carry_their_source(spark):
    html = "<html><head><title> A\n page </title></head><body><p>" + "Body text of the page. " * 60 + "</p></body></html>"
    df = spark.createDataFrame([(1, "https://www.site.example/x", html), (2, None, "<p>" + "word " * 30 + "</p>"), (3, "https://a.example", None)], "page_id bigint, url string, html string")
    got = passages.chunk_pages(df).orderBy("page_id", "chunk_no").collect()
    assert {(r.page_id, r.source_url, r.source_title, r.source_domain) for r in got} == {(1, "https://www.site.example/x", "A page", "site.example"), (2, None, "", "")}
    assert [r.chunk_no for r in got if r.page_id == 1] == list(range(sum(r.page_id == 1 for r in got))) and sum(r.page_id == 1 for r in got) > 2


def test_baseline_versions(spark):
    path = scratch(spark, "baseline")
    assert evals.read_baseline(spark, path) is None
    row = lambda x: spark.createDataFrame([(x, None)], "mean_coverage double, note string")
    first = evals.update_baseline(row(0.5), path)
    assert evals.update_baseline(row(0.5), path) == first and evals.update_baseline(row(0.7), path) != first
    assert evals.read_baseline(spark, path).first().mean_coverage == 0.7 and spark.read.parquet(f"{path}/versions/*").count() == 2
    assert evals.update_baseline(row(0.5), path) == first and evals.read_baseline(spark, path).first().mean_coverage == 0.5


def test_sketched_percentile_keeps_its_bound(spark):
    n, accuracy = 40_000, 50
    spans = spark.range(n).selectExpr("'s' AS stage", "CAST(pmod(hash(id), 100003) AS DOUBLE) AS duration", "false AS failed").repartition(7)
    p95 = trace.stage_latency(spans, accuracy).first().p95
    below, upto = spans.agg(F.count(F.when(F.col("duration") < p95, 1)), F.count(F.when(F.col("duration") <= p95, 1))).first()
    assert below <= 0.95 * n + n / accuracy + 1 and upto >= 0.95 * n - n / accuracy - 1


def test_report_without_failures(spark):
    summary = spark.createDataFrame([(1, 0, 0, 0.5, 0.125, 1.0, 1.0, 2.0, 0.5, 1500, 0.0)], "queries bigint, errors bigint, total_invalid_citations bigint, mean_coverage double, mean_utilization double, format_compliance_rate double, triage_format_match_rate double, mean_sources double, mean_top_rerank_score double, mean_latency_ms bigint, total_cost_usd double")
    scores = spark.createDataFrame([(7, "research", "", False, 0.5, 1.0, [3], 1250, 0.00125)], "turn_id bigint, mode string, declared string, format_ok boolean, coverage double, utilization double, invalid array<int>, latency_ms bigint, cost_usd double")
    none = spark.createDataFrame([], "metric string, before double, after double, tolerance double")
    failed = spark.createDataFrame([], "turn_id bigint, problems array<string>")
    lines = [r.line for r in evals.report_lines(summary, scores, none, failed, "now").orderBy("section", "place", "id").collect()]
    assert lines[0] == "# Eval run — PASS" and "| Source utilization | 12% |" in lines and lines[-1] == "| 7 | research | — ⚠ | 50% | 100% | 1 | 1.2s | $0.00125 |"
    assert "## Regressions" not in lines and "## Hard failures" not in lines
