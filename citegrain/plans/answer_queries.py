"""Queries over answers, sources, calls and request logs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import text as T
from ..operators import answer_store as A
from ..operators import citations as C
from ..operators import reuse as R
from ..operators import trace as S
from ..operators import usage as U
from ..storage import stored
from . import relations_sql as Q
from .catalog import query

query("citation_audit", f"""WITH {Q.ANSWERS}, m AS (SELECT turn_id, n_sources AS n, {Q.MARKERS} AS m FROM answers)
SELECT turn_id, CAST(len(m) AS BIGINT) AS n_markers, CAST(len(list_distinct(list_filter(m, lambda x: x >= 1 AND x <= n))) AS BIGINT) AS n_valid_distinct,
  array_to_string(list_sort(list_distinct(list_filter(m, lambda x: x < 1 OR x > n))), ',') AS invalid,
  CAST(len(list_distinct(list_filter(m, lambda x: x < 1 OR x > n))) AS BIGINT) AS n_invalid,
  round(len(list_distinct(list_filter(m, lambda x: x >= 1 AND x <= n))) / n, 6) AS utilization, round(CAST(least(0.9, 0.5 + 0.08 * n) AS DOUBLE), 2) AS confidence FROM m""")(
    lambda spark, d: C.citation_audit(X.answers(spark, d)).withColumn("invalid", F.array_join(F.col("invalid").cast("array<string>"), ","))
)

query("resolve_citations", f"""WITH {Q.ANSWERS}, {Q.SOURCES}, u AS (SELECT turn_id, answer, unnest(list_distinct({Q.MARKERS})) AS idx FROM answers),
j AS (SELECT u.*, s.url, s.title, instr(answer, concat('[', u.idx, ']')) - 1 AS pos, len(concat('[', u.idx, ']')) AS ml FROM u JOIN sources s ON s.turn_id = u.turn_id AND s.idx = u.idx),
k AS (SELECT *, greatest(pos - 299, 0) AS low, pos + ml AS behind FROM j),
l AS (SELECT *, len(regexp_extract(substr(answer, low + 1, CAST(greatest(pos - 2 - low, 0) AS INT)), '(?s)^.*[.!?\\n]', 0)) AS upto, len(regexp_extract(substr(answer, behind + 1, 300), '(?s)^[^.!?\\n]*[.!?\\n]', 0)) AS ahead FROM k),
e AS (SELECT *, CASE WHEN upto > 0 THEN low + upto ELSE greatest(pos - 150, 0) END AS st, CASE WHEN ahead > 0 THEN behind + ahead ELSE least(len(answer), pos + 200) END AS en FROM l)
SELECT turn_id, idx, url, title, CASE WHEN pos >= 0 THEN substr(trim(regexp_replace(substr(answer, st + 1, greatest(en - st, 0)), '\\[\\d+\\]', '', 'g')), 1, 300) ELSE '' END AS claim FROM e""")(
    lambda spark, d: C.resolve_citations(X.answers(spark, d), X.sources(spark, d))
)

query("number_sources", f"WITH {Q.TURNS}, {Q.RANKED}, {Q.NUMBERED} SELECT * FROM numbered")(lambda spark, d: C.number_sources(X.ranked(spark, d)))


def _numbered(spark, d):
    """Ranked passages and those numbered, each written once, as queries take them several times."""
    ranked = stored(X.ranked(spark, d), "ranked")
    return ranked, stored(C.number_sources(ranked), "numbered")


def _results(spark, d):
    """Search results of each turn's first source URLs, with repeats, of which the last counts."""
    return X.ranked(spark, d).where("position % 2 = 0").select("turn_id", F.col("position").alias("idx"), F.col("source_url").alias("url"), F.expr("CASE WHEN position % 4 = 0 THEN '' ELSE concat('Result ', position) END").alias("title"))


_ENRICHED = f"""{Q.TURNS}, {Q.RANKED}, {Q.NUMBERED}, res AS (SELECT turn_id, source_url AS url, arg_max(CASE WHEN position % 4 = 0 THEN '' ELSE concat('Result ', position) END, position) AS title FROM ranked WHERE position % 2 = 0 GROUP BY ALL),
fst AS (SELECT turn_id, idx, url, arg_min(text, position) AS snippet FROM numbered GROUP BY ALL),
enriched AS (SELECT f.turn_id, f.idx, f.url, coalesce(nullif(r.title, ''), regexp_extract(f.url, '^https://([^/]*)', 1)) AS title, replace(regexp_extract(f.url, '^https://([^/]*)', 1), 'www.', '') AS domain,
  concat('https://www.google.com/s2/favicons?domain=', replace(regexp_extract(f.url, '^https://([^/]*)', 1), 'www.', ''), '&sz=32') AS favicon, substr(snippet, 1, 200) AS snippet FROM fst f LEFT JOIN res r USING (turn_id, url))"""
query("enrich_sources", f"WITH {_ENRICHED} SELECT * FROM enriched")(lambda spark, d: C.enrich_sources(_numbered(spark, d)[1], _results(spark, d)))
query("cited_context", f"""WITH {_ENRICHED}, ev AS (SELECT turn_id, idx, string_agg(text, chr(10) ORDER BY position) AS evidence FROM numbered GROUP BY ALL)
SELECT turn_id, string_agg(concat('[', idx, '] ', title, ' (', domain, ')', chr(10), evidence), concat(chr(10), chr(10)) ORDER BY idx) AS context FROM enriched JOIN ev USING (turn_id, idx) GROUP BY turn_id""")(
    lambda spark, d: C.cited_context(C.enrich_sources(_numbered(spark, d)[1], _results(spark, d)), _numbered(spark, d)[1])
)
query("sources_prompt", f"""WITH {_ENRICHED} SELECT turn_id, string_agg(concat('[', idx, '] ', title, ' (', domain, ')', chr(10), CASE WHEN snippet <> '' THEN concat('    ', snippet, chr(10)) ELSE '' END, '    URL: ', url, chr(10)), chr(10) ORDER BY idx) AS prompt FROM enriched GROUP BY turn_id""")(
    lambda spark, d: C.sources_prompt(C.enrich_sources(_numbered(spark, d)[1], _results(spark, d)))
)

_TRACED = f"""{Q.ANSWERS}, {Q.RANKED}, {Q.NUMBERED},
cites AS (SELECT DISTINCT u.turn_id, n.url, n.idx FROM (SELECT turn_id, unnest(list_distinct({Q.MARKERS})) AS idx FROM answers) u JOIN numbered n USING (turn_id, idx)),
traced AS (SELECT turn_id, source_url AS url, min(position) AS first, max(score) AS score, count(*) AS chunks, arg_max(text, score - position / 1000.0) AS best FROM ranked WHERE source_url <> '' GROUP BY ALL),
shown AS (SELECT *, trim(regexp_replace(best, '\\s+', ' ', 'g')) AS preview FROM traced),
status AS (SELECT s.*, c.idx AS citation_index, CASE WHEN c.idx IS NOT NULL THEN 'cited' WHEN n.url IS NOT NULL THEN 'sent' ELSE 'considered' END AS status
  FROM shown s LEFT JOIN cites c USING (turn_id, url) LEFT JOIN (SELECT DISTINCT turn_id, url FROM numbered) n USING (turn_id, url))"""


def _trace_parts(spark, d):
    ranked, numbered = _numbered(spark, d)
    used = X.answers(spark, d).select("turn_id", F.explode(F.array_distinct(T.citation_markers(F.col("answer")))).alias("idx"))
    return ranked, numbered, used.join(numbered, ["turn_id", "idx"]).select("turn_id", "url", "idx").distinct()


query("trace_sources", f"WITH {_TRACED} SELECT turn_id, url, first, score, chunks, preview FROM shown")(lambda spark, d: S.trace_sources(X.ranked(spark, d)))
query("trace_top", f"""WITH {_TRACED} SELECT turn_id, CAST(rank AS INT) AS rank, url, replace(regexp_extract(url, '^https://([^/]*)', 1), 'www.', '') AS domain, round(score, 4) AS score, chunks, status, citation_index, preview
FROM (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY score DESC, (status = 'cited') DESC, first) AS rank FROM status) WHERE rank <= 25""")(
    lambda spark, d: (lambda r, n, c: S.trace_top(S.source_status(S.trace_sources(r), n, c)))(*_trace_parts(spark, d))
)
query("trace_counts", f"""WITH {_TRACED} SELECT turn_id, count(*) AS chunks_ranked, count(CASE WHEN source_url <> '' AND text <> '' THEN 1 END) AS chunks_kept, count(DISTINCT nullif(source_url, '')) AS sources_considered,
  coalesce(any_value(ns), 0) AS sources_sent, coalesce(any_value(nc), 0) AS sources_cited FROM ranked LEFT JOIN (SELECT turn_id, count(DISTINCT url) AS ns FROM numbered GROUP BY turn_id) USING (turn_id) LEFT JOIN (SELECT turn_id, count(DISTINCT url) AS nc FROM cites GROUP BY turn_id) USING (turn_id) GROUP BY turn_id""")(
    lambda spark, d: (lambda r, n, c: S.trace_counts(r, n, c))(*_trace_parts(spark, d))
)
query("stage_summary", f"""WITH {Q.ANSWERS}, {Q.RANKED} SELECT a.turn_id, chunks, top_score, CAST(len(answer) AS BIGINT) AS answer_chars, CAST(len({Q.MARKERS}) AS BIGINT) AS markers
FROM answers a LEFT JOIN (SELECT turn_id, count(*) AS chunks, max(score) AS top_score FROM ranked GROUP BY turn_id) USING (turn_id)""")(lambda spark, d: S.stage_summary(X.ranked(spark, d), X.answers(spark, d)))
query("stage_latency", """SELECT event_type AS stage, count(*) AS n, round(avg(value), 4) AS mean, max(value) AS highest, round(avg(CASE WHEN value > 20 THEN 1 ELSE 0 END), 4) AS error_rate, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY event_type""")(
    lambda spark, d: S.stage_latency(X.table(spark, d, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("duration"), (F.col("value") > 20).alias("failed")))
)
query("preview_redaction", """SELECT doc_id, CASE WHEN len(text) > 2000 THEN concat(substr(text, 1, 2000), '… [+', len(text) - 2000, ' chars]') ELSE text END AS shown FROM documents""")(
    lambda spark, d: X.table(spark, d, "documents").select("doc_id", T.preview_col(F.col("text"), 2000).alias("shown"))
)
query("sample_traces")(lambda spark, d: S.sample_traces(X.turns(spark, d), 0.25).select("turn_id"))

query("usage_by_turn", f"WITH {Q.CALLS} SELECT turn_id, count(*) AS calls, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, round(sum(cost_usd), 6) AS cost_usd FROM priced GROUP BY turn_id")(
    lambda spark, d: U.usage_by_turn(U.price_calls(X.llm_calls(spark, d), X.prices(spark)))
)
query("usage_rollup", f"WITH {Q.CALLS} SELECT turn_id, stage, count(*) AS calls, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, round(sum(cost_usd), 6) AS cost_usd FROM (SELECT * REPLACE (coalesce(nullif(stage, ''), 'unknown') AS stage) FROM priced) GROUP BY GROUPING SETS ((turn_id, stage), (turn_id))")(
    lambda spark, d: U.usage_rollup(U.price_calls(X.llm_calls(spark, d), X.prices(spark)))
)
query("cost_report", f"WITH {Q.CALLS} SELECT day, user_id, count(*) AS calls, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, round(sum(cost_usd), 4) AS cost_usd FROM (SELECT *, CAST(ts AS DATE) AS day FROM priced) GROUP BY CUBE (day, user_id)")(
    lambda spark, d: U.cost_report(U.price_calls(X.llm_calls(spark, d), X.prices(spark)))
)

_FOLD = """r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
w AS (WITH RECURSIVE f AS (
  SELECT user_id, event_id, rn, ts AS window_start, CAST(1 AS BIGINT) AS n FROM r WHERE rn = 1
  UNION ALL
  SELECT r.user_id, r.event_id, r.rn, CASE WHEN r.ts >= f.window_start + INTERVAL 86400 SECOND THEN r.ts ELSE f.window_start END, CASE WHEN r.ts >= f.window_start + INTERVAL 86400 SECOND THEN 1 ELSE f.n + 1 END
  FROM f JOIN r ON r.user_id = f.user_id AND r.rn = f.rn + 1) SELECT * FROM f)"""
query("anchored_windows", f"WITH {_FOLD} SELECT user_id, event_id, window_start, n, n > 2 AS exceeded FROM w")(lambda spark, d: R.anchored_windows(X.table(spark, d, "events"), duration_s=86400, limit=2))
query("rate_limit_status", f"WITH {_FOLD} SELECT user_id, arg_max(n, rn) AS used, CAST(2 AS BIGINT) AS \"limit\", CAST(greatest(2 - arg_max(n, rn), 0) AS BIGINT) AS remaining FROM w GROUP BY user_id")(
    lambda spark, d: R.rate_limit_status(R.anchored_windows(X.table(spark, d, "events"), duration_s=86400, limit=2), limit=2)
)
_REUSE = f"""{Q.REQUESTS}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY ts, event_id) AS rn FROM requests),
a AS (WITH RECURSIVE f AS (
  SELECT query, event_id, rn, ts, 'miss' AS kind, CASE WHEN cacheable THEN event_id END AS sid, CASE WHEN cacheable THEN ts END AS sts, CASE WHEN time_sensitive THEN 900 ELSE 21600 END AS ttl, CAST(NULL AS BIGINT) AS hit_id, CAST(NULL AS TIMESTAMP) AS hit_ts FROM r WHERE rn = 1
  UNION ALL
  SELECT r.query, r.event_id, r.rn, r.ts, CASE WHEN f.sts IS NOT NULL AND r.ts < f.sts + to_seconds(f.ttl) THEN 'hit' ELSE 'miss' END,
    CASE WHEN (f.sts IS NULL OR r.ts >= f.sts + to_seconds(f.ttl)) AND r.cacheable THEN r.event_id ELSE f.sid END,
    CASE WHEN (f.sts IS NULL OR r.ts >= f.sts + to_seconds(f.ttl)) AND r.cacheable THEN r.ts ELSE f.sts END,
    CASE WHEN (f.sts IS NULL OR r.ts >= f.sts + to_seconds(f.ttl)) AND r.cacheable THEN CASE WHEN r.time_sensitive THEN 900 ELSE 21600 END ELSE f.ttl END,
    CASE WHEN f.sts IS NOT NULL AND r.ts < f.sts + to_seconds(f.ttl) THEN f.sid END, CASE WHEN f.sts IS NOT NULL AND r.ts < f.sts + to_seconds(f.ttl) THEN f.sts END
  FROM f JOIN r ON r.query = f.query AND r.rn = f.rn + 1) SELECT * FROM f)"""
query("reuse_attribution", f"WITH {_REUSE} SELECT event_id, kind, hit_id AS stored_event_id, CAST(floor(epoch(ts - hit_ts)) AS BIGINT) AS age_s FROM a")(lambda spark, d: R.reuse_attribution(X.requests(spark, d)))



def _exact_reuse(spark, d):
    requests = X.requests(spark, d).withColumnRenamed("query", "key")
    answers = requests.where("event_id % 3 = 0").withColumn("ttl_s", R.ttl_for(F.col("time_sensitive"))).withColumn("answer", F.expr("CASE WHEN event_id % 15 = 0 THEN ' ' ELSE concat('answer ', event_id) END"))
    name = f"stored_answers_{uuid.uuid4().hex}"
    A.save_answers(answers.select("key", "event_id", "ts", "ttl_s", "answer"), name)
    return A.exact_reuse(requests.where("event_id % 3 <> 0").select("event_id", "key", "ts"), name)


query("exact_reuse", f"""WITH {Q.REQUESTS}, s AS (
  SELECT query AS key, ts, max(event_id) AS stored_event_id, arg_max(CASE WHEN time_sensitive THEN 900 ELSE 21600 END, event_id) AS ttl_s, arg_max(CASE WHEN event_id % 15 = 0 THEN ' ' ELSE concat('answer ', event_id) END, event_id) AS answer
  FROM requests WHERE event_id % 3 = 0 GROUP BY ALL
), j AS (
  SELECT r.event_id, r.query AS key, s.stored_event_id, s.answer, r.ts - s.ts AS age, r.ts < s.ts + to_seconds(s.ttl_s) AND trim(s.answer) <> '' AS hit FROM (SELECT * FROM requests WHERE event_id % 3 <> 0) r ASOF LEFT JOIN s ON s.key = r.query AND r.ts >= s.ts
)
SELECT event_id, key, CASE WHEN hit THEN 'hit' ELSE 'miss' END AS kind, CASE WHEN hit THEN stored_event_id END AS stored_event_id, CASE WHEN hit THEN answer END AS answer, CASE WHEN hit THEN CAST(floor(epoch(age)) AS BIGINT) END AS age_s
FROM j""")(_exact_reuse)

_LIST = lambda words: "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
_GUARD = f"""CASE WHEN trim(a) = '' OR trim(b) = '' THEN 'empty question'
 WHEN len(dn) > 0 THEN concat('different numbers (', array_to_string(dn, ', '), ')') WHEN len(dp) > 0 THEN concat('different polarity (', array_to_string(dp, ', '), ')')
 WHEN oa <> ob THEN 'comparison asked in the opposite order' WHEN ov < 0.3 THEN printf('low word overlap (%.2f < 0.30)', ov) END"""


def _guards(pairs: str) -> str:
    """CTEs from `pairs` (.., a, b) to `judged` (.., reason)."""
    words = lambda c: f"regexp_extract_all(lower({c}), '[a-z0-9'']+')"
    content = lambda c: f"list_distinct(list_filter({words(c)}, lambda w: len(w) > 1 AND NOT regexp_full_match(w, '\\d+') AND NOT list_contains({_LIST(T.STOPWORDS)}, w)))"
    numbers = lambda c: f"list_distinct(regexp_extract_all({c}, '\\d+(?:\\.\\d+)*'))"
    polar = lambda c: f"list_distinct(list_filter({words(c)}, lambda w: list_contains({_LIST(T.POLARITY)}, w)))"
    order = lambda c: f"nullif(regexp_extract(array_to_string({words(c)}, ' '), '^(?:.* )??([a-z0-9'']+) (?:vs|versus) ([a-z0-9'']+)', 0), '')"
    diff = lambda x, y: f"list_sort(list_concat(list_filter({x}, lambda w: NOT list_contains({y}, w)), list_filter({y}, lambda w: NOT list_contains({x}, w))))"
    pair = lambda c: f"regexp_extract(array_to_string({words(c)}, ' '), '(?:^| )([a-z0-9'']+ (?:vs|versus) [a-z0-9'']+)', 1)"
    return f"""g1 AS (SELECT *, {numbers('a')} AS na, {numbers('b')} AS nb, {polar('a')} AS pa, {polar('b')} AS pb, {content('a')} AS ca, {content('b')} AS cb, nullif({pair('a')}, '') AS oa, nullif({pair('b')}, '') AS ob FROM {pairs}),
g2 AS (SELECT *, {diff('na', 'nb')} AS dn, {diff('pa', 'pb')} AS dp, CASE WHEN len(ca) > 0 AND len(cb) > 0 THEN len(list_intersect(ca, cb)) / CAST(len(list_distinct(list_concat(ca, cb))) AS DOUBLE) ELSE 0 END AS ov FROM g1),
judged AS (SELECT *, {_GUARD} AS reason FROM g2)"""


query("semantic_guards", f"WITH {Q.QUESTIONS}, pairs AS (SELECT x.q_id AS query_id, y.q_id AS candidate_id, x.question AS a, y.question AS b FROM questions x JOIN questions y ON x.item_id = y.item_id AND x.q_id < y.q_id), {_guards('pairs')} SELECT query_id, candidate_id, reason, round(ov, 6) AS overlap FROM judged")(
    lambda spark, d: (lambda q: q.alias("x").join(q.alias("y"), F.expr("x.item_id = y.item_id AND x.q_id < y.q_id")).select(
        F.col("x.q_id").alias("query_id"), F.col("y.q_id").alias("candidate_id"), T.rejection_reason(F.col("x.question"), F.col("y.question")).alias("reason"), F.round(T.token_overlap(F.col("x.question"), F.col("y.question")), 6).alias("overlap")))(X.questions(spark, d))
)
_PAIRS = f"""{Q.QUESTIONS}, v AS (SELECT e.vec_id, e.label AS bucket, CAST(e.embedding AS DOUBLE[]) AS e, q.question FROM embeddings e JOIN questions q ON q.q_id = (e.vec_id // 40 * 8 + e.vec_id % 8) % (SELECT max(q_id) + 1 FROM questions)),
near AS (SELECT * FROM (SELECT x.vec_id AS query_id, y.vec_id AS candidate_id, round(list_dot_product(x.e, y.e), 5) AS similarity, x.question AS a, y.question AS b FROM v x JOIN v y ON x.bucket = y.bucket AND x.vec_id % 5 = 0 AND y.vec_id % 5 <> 0) WHERE similarity >= 0.1), {_guards('near')}, tried AS (SELECT *, max(usable) OVER before AS won, count(reason) OVER before AS n_rejected_before FROM (
  SELECT *, reason IS NULL AND NOT (candidate_id % 4 = 0 AND 1000 + query_id % 50 - (1000 - candidate_id % 20 * 15) > 120) AND candidate_id % 7 NOT IN (1, 2) AS usable FROM judged WHERE similarity >= 0.25)
  WINDOW before AS (PARTITION BY query_id ORDER BY similarity DESC, candidate_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
won AS (SELECT *, usable AND NOT coalesce(won, false) AS wins, reason IS NOT NULL AND NOT coalesce(won, false) AS rejected FROM tried)"""


query("semantic_reuse", f"WITH {_PAIRS} SELECT query_id, candidate_id, similarity, b AS matched_query, n_rejected_before FROM won WHERE wins")(lambda spark, d: R.won(R.tried_in_blocks(*X.semantic(spark, d), 0.25)))
query("cache_stats", f"""WITH {_REUSE}, {_PAIRS}, x AS (SELECT count(CASE WHEN kind = 'hit' THEN 1 END) AS hits, count(CASE WHEN kind <> 'hit' THEN 1 END) AS misses FROM a),
s AS (SELECT count(CASE WHEN wins THEN 1 END) AS semantic_hits, count(CASE WHEN rejected THEN 1 END) AS semantic_rejected FROM won)
SELECT *, round(hits / (hits + misses), 3) AS hit_rate, round(semantic_hits / misses, 3) AS rescue_rate FROM x, s""")(
    lambda spark, d: R.stats_of(R.reuse_counts(X.requests(spark, d)), R.tried_in_blocks(*X.semantic(spark, d), 0.25))
)
query("threshold_sweep", f"""WITH {_PAIRS} SELECT threshold, CAST(count(CASE WHEN reason IS NULL THEN 1 END) AS BIGINT) AS accepted, CAST(count(reason) AS BIGINT) AS rejected, round(count(CASE WHEN reason IS NULL THEN 1 END) / count(*), 4) AS accepted_share
FROM judged JOIN (VALUES (CAST(0.1 AS DOUBLE)), (0.2), (0.3), (0.4)) g(threshold) ON similarity >= threshold GROUP BY threshold""")(
    lambda spark, d: R.sweep_in_blocks(*X.semantic(spark, d)[:2], [0.1, 0.2, 0.3, 0.4])
)
query("prune_index", "SELECT vec_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS r FROM embeddings) WHERE r <= 10")(
    lambda spark, d: R.prune_index(X.table(spark, d, "embeddings").select("vec_id", F.col("label"), F.col("label").alias("bucket"), F.col("vec_id").alias("t")), cap=10).select("vec_id", "label")
)
