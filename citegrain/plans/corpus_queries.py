"""Queries over answer structure, run scores, search results, passages and threads."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import text as T
from ..operators import evals as E
from ..operators import passages as P
from ..operators import retrieval as V
from ..operators import threads as H

from . import relations_sql as Q
from .catalog import query

_RE = {k: getattr(T, k).replace("'", "''") for k in ("SEPARATOR", "ROW", "HEADING", "BULLET", "ORDERED", "FENCE")}
_LINES = f"""{Q.ANSWERS}, raw AS (SELECT turn_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS i FROM (SELECT turn_id, CASE WHEN answer LIKE concat('%', chr(10)) THEN str_split(answer, chr(10))[:-2] ELSE str_split(answer, chr(10)) END AS l FROM answers)),
fenced AS (SELECT *, sum(CASE WHEN regexp_matches(line, '{_RE["FENCE"]}') THEN 1 ELSE 0 END) OVER (PARTITION BY turn_id ORDER BY i) AS f FROM raw),
lines AS (SELECT turn_id, i, line, CASE WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(line, '{_RE["HEADING"]}') THEN 'heading' WHEN regexp_matches(line, '{_RE["SEPARATOR"]}') THEN 'separator'
  WHEN regexp_matches(line, '{_RE["ROW"]}') THEN 'row' WHEN regexp_matches(line, '{_RE["BULLET"]}') OR regexp_matches(line, '{_RE["ORDERED"]}') THEN 'item' ELSE 'prose' END AS kind
  FROM fenced WHERE f % 2 = 0 AND NOT regexp_matches(line, '{_RE["FENCE"]}'))"""
_UNITS = _LINES + """, placed AS (SELECT *, sum(CASE WHEN kind IN ('blank', 'heading', 'row', 'item') THEN 1 ELSE 0 END) OVER (PARTITION BY turn_id ORDER BY i) AS island, sum(CASE WHEN kind = 'blank' THEN 1 ELSE 0 END) OVER (PARTITION BY turn_id ORDER BY i) AS block FROM lines),
marked AS (SELECT *, max(CASE WHEN kind = 'separator' THEN 1 ELSE 0 END) OVER (PARTITION BY turn_id, block ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS data FROM placed),
prose AS (SELECT turn_id, min(i) AS i, string_agg(trim(line), ' ' ORDER BY i) AS p FROM marked WHERE kind = 'prose' GROUP BY turn_id, island),
units AS (
  SELECT * FROM (SELECT turn_id, i, trim(unnest(str_split(regexp_replace(p, '([.!?])\\s+([A-Z0-9"''\\[])', '\\1' || chr(1) || '\\2', 'g'), chr(1)))) AS unit FROM prose) WHERE len(unit) >= 45
  UNION ALL SELECT * FROM (SELECT turn_id, i, regexp_replace(trim(line), '^\\s*(?:[-*+]|\\d+[.)])\\s+', '') AS unit FROM marked WHERE kind = 'item') WHERE len(unit) >= 45
  UNION ALL SELECT turn_id, i, trim(line) FROM marked WHERE kind = 'row' AND data = 1 AND len(list_filter(str_split(trim(trim(line), '|'), '|'), lambda c: len(trim(c)) >= 2)) > 0)"""
query("markdown_lines", f"WITH {_LINES} SELECT turn_id, CAST(i AS INT) AS i, line, kind FROM lines")(lambda spark, d: E.markdown_lines(X.answers(spark, d)))
query("claim_units", f"WITH {_UNITS} SELECT turn_id, CAST(i AS INT) AS i, unit FROM units")(lambda spark, d: E.claim_units(E.markdown_lines(X.answers(spark, d))))
query("citation_coverage", f"WITH {_UNITS} SELECT turn_id, count(CASE WHEN regexp_matches(unit, '\\[\\d+\\]') THEN 1 END) AS cited_units, count(*) AS total_units FROM units GROUP BY turn_id")(lambda spark, d: E.citation_coverage(E.claim_units(E.markdown_lines(X.answers(spark, d)))))
_STRUCTURE = f"""nx AS (SELECT *, lead(kind) OVER (PARTITION BY turn_id ORDER BY i) AS nk, regexp_matches(line, '{_RE["ROW"]}') AS is_row FROM lines),
structure AS (SELECT turn_id, count(CASE WHEN (regexp_matches(line, '{_RE["BULLET"]}') OR regexp_matches(line, '{_RE["ORDERED"]}')) AND NOT is_row THEN 1 END) AS list_items, count(CASE WHEN regexp_matches(line, '{_RE["ORDERED"]}') AND NOT is_row THEN 1 END) AS ordered_items,
  CAST(coalesce(arg_min(CASE WHEN is_row AND nk = 'separator' THEN len(str_split(trim(trim(line), '|'), '|')) END, CASE WHEN is_row AND nk = 'separator' THEN i END), 0) AS BIGINT) AS table_columns,
  coalesce(bool_or(CASE WHEN is_row AND nk = 'separator' THEN len(str_split(trim(trim(line), '|'), '|')) >= 2 END), false) AS has_table FROM nx GROUP BY turn_id)"""
query("answer_structure", f"WITH {_LINES}, {_STRUCTURE} SELECT * FROM structure")(lambda spark, d: E.structure(E.markdown_lines(X.answers(spark, d))))


def _runs(spark, d):
    """One evaluation run for each turn; every thirteenth fails."""
    ranked = X.ranked(spark, d).groupBy("turn_id").agg(F.count(F.lit(1)).alias("ranked_chunks"), F.max("score").alias("top_score"))
    kinds = F.array(*map(F.lit, ("prose", "list", "steps", "table")))
    return X.answers(spark, d).join(ranked, "turn_id").select(
        "turn_id", "query", "answer", "n_sources", F.when(F.col("turn_id") % 5 == 0, "chat").otherwise("research").alias("mode"), F.element_at(kinds, (F.col("fmt") + 1).cast("int")).alias("declared"), F.element_at(kinds, (F.col("turn_id") % 3 + 1).cast("int")).alias("expected"),
        F.array(F.lit("the"), F.lit("zebra")).alias("must_mention"), "ranked_chunks", "top_score", (F.col("turn_id") % 900 + 100).alias("latency_ms"), (F.col("turn_id") % 700).alias("total_tokens"), (F.col("turn_id") % 7 / 1000).alias("cost_usd"), F.when(F.col("turn_id") % 13 == 0, "timeout").otherwise("").alias("error"),
    )


_SCORES = f"""{_UNITS}, {_STRUCTURE}, {Q.RANKED}, rk AS (SELECT turn_id, count(*) AS ranked_chunks, max(score) AS top_score FROM ranked GROUP BY turn_id),
cov AS (SELECT turn_id, count(CASE WHEN regexp_matches(unit, '\\[\\d+\\]') THEN 1 END) AS cited_units, count(*) AS total_units FROM units GROUP BY turn_id),
runs AS (SELECT a.*, {Q.MARKERS} AS m, CASE WHEN turn_id % 5 = 0 THEN 'chat' ELSE 'research' END AS mode, ['prose', 'list', 'steps', 'table'][fmt + 1] AS declared, ['prose', 'list', 'steps', 'table'][turn_id % 3 + 1] AS expected, CASE WHEN turn_id % 13 = 0 THEN 'timeout' ELSE '' END AS error FROM answers a),
scores AS (SELECT r.turn_id, r.query, r.error, trim(answer) <> '' AS answered, false AS fallback, mode, declared, expected, coalesce(cited_units, 0) AS cited_units, coalesce(total_units, 0) AS total_units, coalesce(round(cited_units / total_units, 6), 0) AS coverage,
  CAST(len(list_distinct(list_filter(m, lambda x: x >= 1 AND x <= n_sources))) AS BIGINT) AS sources_used, n_sources AS sources_provided, round(len(list_distinct(list_filter(m, lambda x: x >= 1 AND x <= n_sources))) / n_sources, 6) AS utilization, list_sort(list_distinct(list_filter(m, lambda x: x < 1 OR x > n_sources))) AS invalid, ranked_chunks, top_score,
  mode = 'chat' OR CASE declared WHEN 'table' THEN coalesce(has_table, false) WHEN 'steps' THEN coalesce(ordered_items, 0) >= 2 WHEN 'list' THEN coalesce(list_items, 0) >= 2 ELSE true END AS format_ok,
  CASE WHEN mode = 'chat' THEN expected = 'prose' ELSE declared = expected END AS triage_format_match, list_filter(['the', 'zebra'], lambda t: NOT contains(lower(answer), t)) AS missing_terms, turn_id % 900 + 100 AS latency_ms, turn_id % 700 AS total_tokens, turn_id % 7 / 1000 AS cost_usd
  FROM runs r LEFT JOIN cov USING (turn_id) LEFT JOIN structure USING (turn_id) LEFT JOIN rk USING (turn_id) WHERE error = ''
  UNION ALL BY NAME SELECT turn_id, query, error FROM runs WHERE error <> '')"""
_FLAT = "turn_id, query, error, answered, fallback, mode, declared, expected, cited_units, total_units, coverage, sources_used, sources_provided, utilization, array_to_string(invalid, ',') AS invalid, ranked_chunks, top_score, format_ok, triage_format_match, array_to_string(missing_terms, ',') AS missing_terms, latency_ms, total_tokens, cost_usd"
query("score_runs", f"WITH {_SCORES} SELECT {_FLAT} FROM scores")(lambda spark, d: E.score_runs(_runs(spark, d)).withColumn("invalid", F.array_join(F.col("invalid").cast("array<string>"), ",")).withColumn("missing_terms", F.array_join("missing_terms", ",")))
_SUMMARY = """summary AS (SELECT count(*) AS queries, count(CASE WHEN error <> '' THEN 1 END) AS errors, CAST(coalesce(sum(CASE WHEN error = '' THEN len(invalid) END), 0) AS BIGINT) AS total_invalid_citations,
  round(coalesce(avg(CASE WHEN r THEN coverage END), 0), 4) AS mean_coverage, round(coalesce(avg(CASE WHEN r THEN utilization END), 0), 4) AS mean_utilization, round(coalesce(avg(CASE WHEN r THEN CAST(format_ok AS INT) END), 0), 4) AS format_compliance_rate,
  round(coalesce(avg(CASE WHEN error = '' THEN CAST(triage_format_match AS INT) END), 0), 4) AS triage_format_match_rate, round(coalesce(avg(CASE WHEN r THEN sources_provided END), 0), 4) AS mean_sources, round(coalesce(avg(CASE WHEN r THEN ranked_chunks END), 0), 4) AS mean_ranked_chunks,
  round(coalesce(avg(CASE WHEN r THEN top_score END), 0), 4) AS mean_top_rerank_score, CAST(floor(coalesce(avg(CASE WHEN error = '' THEN latency_ms END), 0)) AS BIGINT) AS mean_latency_ms, round(coalesce(sum(cost_usd), 0), 6) AS total_cost_usd, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS total_tokens
  FROM (SELECT *, error = '' AND mode = 'research' AND NOT fallback AS r FROM scores))"""
query("eval_summary", f"WITH {_SCORES}, {_SUMMARY} SELECT * FROM summary")(lambda spark, d: E.summarize(E.score_runs(_runs(spark, d))))
query("hard_failures", f"""WITH {_SCORES} SELECT turn_id, CASE WHEN error <> '' THEN concat('run failed: ', error) ELSE concat_ws('; ', CASE WHEN NOT answered THEN 'empty answer' END, CASE WHEN len(invalid) > 0 THEN concat('fabricated citation markers: [', array_to_string(invalid, ', '), ']') END, CASE WHEN len(missing_terms) > 0 THEN concat('missing required terms: ', array_to_string(missing_terms, ', ')) END) END AS problems
FROM scores WHERE error <> '' OR NOT answered OR len(invalid) > 0 OR len(missing_terms) > 0""")(
    lambda spark, d: E.hard_failures(E.score_runs(_runs(spark, d)), X.turns(spark, d).select("turn_id", F.lit(False).alias("allow_fallback"))).withColumn("problems", F.array_join("problems", "; "))
)
query("compare_to_baseline", f"""WITH {_SCORES}, {_SUMMARY} SELECT * FROM (SELECT unnest(['mean_coverage', 'mean_utilization', 'format_compliance_rate', 'triage_format_match_rate']) AS metric, unnest([0.95, 0.5, 1.0, 0.3]::DOUBLE[]) AS before, unnest([mean_coverage, mean_utilization, format_compliance_rate, triage_format_match_rate]::DOUBLE[]) AS after, unnest([0.1, 0.1, 0.15, 0.15]::DOUBLE[]) AS tolerance FROM summary) WHERE after < before - tolerance""")(
    lambda spark, d: E.compare_to_baseline(E.summarize(E.score_runs(_runs(spark, d))), spark.sql("SELECT 0.95D AS mean_coverage, 0.5D AS mean_utilization, 1.0D AS format_compliance_rate, 0.3D AS triage_format_match_rate"))
)
query("eval_report")(lambda spark, d: E.render_report(E.summarize(E.score_runs(_runs(spark, d)))))
query("eval_spec_problems", "WITH s AS (SELECT CAST(item_id % 30 AS VARCHAR) AS id, CASE WHEN item_id % 7 = 0 THEN ' ' ELSE text END AS query, ['table', 'poem', ''][item_id % 3 + 1] AS fmt FROM benchmark), c AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM s) SELECT id, 'duplicate id' AS problem FROM c WHERE n > 1 UNION ALL SELECT id, 'missing query' FROM c WHERE trim(query) = '' UNION ALL SELECT id, 'unknown format' FROM c WHERE fmt = 'poem'")(
    lambda spark, d: E.load_specs(X.table(spark, d, "benchmark").select((F.col("item_id") % 30).cast("string").alias("id"), F.expr("CASE WHEN item_id % 7 = 0 THEN ' ' ELSE text END").alias("query"), F.expr("element_at(array('table', 'poem', ''), CAST(item_id % 3 + 1 AS INT))").alias("expected_format")))[1]
)


def _search(spark, d):
    """Ranked passages as search results of two sub-queries a turn."""
    return X.ranked(spark, d).select("turn_id", F.col("turn_id").alias("query_id"), (F.col("position") % 2).alias("sub_query"), F.floor((F.col("position") - 1) / 2).alias("position"), F.col("source_url").alias("url"), T.url_domain(F.col("source_url")).alias("domain"), F.col("text").alias("content"))


_SEARCH = f"{Q.TURNS}, {Q.RANKED}, search AS (SELECT turn_id, turn_id AS query_id, position % 2 AS sub_query, (position - 1) // 2 AS position, source_url AS url, regexp_extract(source_url, '^https://([^/]*)', 1) AS domain, text AS content FROM ranked)"
query("cap_per_domain", f"WITH {_SEARCH} SELECT query_id, sub_query, position, url, domain FROM search QUALIFY row_number() OVER (PARTITION BY query_id, sub_query, domain ORDER BY position) <= 2")(
    lambda spark, d: V.cap_per_domain(_search(spark, d).withColumn("q", F.col("query_id")).withColumn("query_id", F.struct("q", "sub_query"))).select(F.col("q").alias("query_id"), "sub_query", "position", "url", "domain")
)
query("select_pages", f"WITH {_SEARCH} SELECT turn_id, sub_query, position, url, position < 2 AS read FROM search QUALIFY row_number() OVER (PARTITION BY turn_id, url ORDER BY sub_query, position) = 1")(lambda spark, d: V.select_pages(_search(spark, d)))
query("page_budget", f"WITH {_SEARCH}, f AS (SELECT * FROM search QUALIFY row_number() OVER (PARTITION BY turn_id, url ORDER BY sub_query, position) = 1) SELECT turn_id, CAST(row_number() OVER (PARTITION BY turn_id ORDER BY sub_query, position) AS INT) AS n, url FROM f QUALIFY row_number() OVER (PARTITION BY turn_id ORDER BY sub_query, position) <= 4")(lambda spark, d: V.page_budget(_search(spark, d)))
query("merge_results", f"WITH {_SEARCH}, b AS (SELECT turn_id, url, position, sub_query AS side FROM search WHERE NOT (sub_query = 0 AND position > 3)), k AS (SELECT * FROM b QUALIFY side = 0 OR row_number() OVER (PARTITION BY turn_id, url ORDER BY side, position) = 1) SELECT turn_id, url, CAST(row_number() OVER (PARTITION BY turn_id ORDER BY side, position) AS INT) AS position FROM k")(
    lambda spark, d: (lambda s: V.merge_results(s.where("sub_query = 0 AND position <= 3").select("turn_id", "url", "position"), s.where("sub_query = 1").select("turn_id", "url", "position")))(_search(spark, d))
)
query("fallback_union", f"WITH {_SEARCH}, pr AS (SELECT turn_id, url, content FROM search WHERE sub_query = 0 AND turn_id % 3 <> 0 AND position < 2), s AS (SELECT turn_id, url, content FROM search WHERE sub_query = 1 AND position < 2), ok AS (SELECT DISTINCT turn_id FROM pr WHERE content <> '') SELECT * FROM pr WHERE turn_id IN (FROM ok) UNION ALL SELECT * FROM s WHERE turn_id NOT IN (FROM ok)")(
    lambda spark, d: (lambda s: V.fallback_union(s.where("sub_query = 0 AND turn_id % 3 <> 0 AND position < 2").select("turn_id", "url", "content"), s.where("sub_query = 1 AND position < 2").select("turn_id", "url", "content")))(_search(spark, d))
)
query("chunk_corpus")(lambda spark, d: P.chunk_text(X.table(spark, d, "documents")))
query("chunk_long_texts")(lambda spark, d: P.chunk_corpus(X.table(spark, d, "documents"), keep=("lang", "source")))
query("chunk_pages")(lambda spark, d: P.chunk_pages(X.table(spark, d, "pages")))


def _by_sql(text):
    def run(spark, d):
        P.register_table_functions(spark)
        return spark.sql(text, documents=X.table(spark, d, "documents"))

    return run


query("chunk_lateral")(_by_sql("SELECT d.doc_id, c.chunk_no, c.passage AS text FROM {documents} d, LATERAL chunk_passages(d.text, 500, 50) c"))
query("chunk_table")(_by_sql("SELECT id AS doc_id, chunk_no, passage AS text FROM chunk_table(TABLE(SELECT doc_id, text FROM {documents}))"))
query("force_split", "SELECT doc_id, CAST(unnest(generate_series(0, (len(text) - 1) // 450)) AS INT) AS chunk_no, substr(text, unnest(generate_series(0, (len(text) - 1) // 450)) * 450 + 1, 500) AS text FROM documents WHERE len(text) > 0")(
    lambda spark, d: X.table(spark, d, "documents").select("doc_id", F.posexplode(T.force_split(F.col("text"))).alias("chunk_no", "text"))
)
_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"
query("bm25_top_k", f"""WITH words AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS w FROM documents), st AS (SELECT count(*) AS n, avg(len(w)) AS al FROM words),
asked AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS term FROM benchmark) WHERE len(term) > 1 AND NOT regexp_full_match(term, '\\d+') AND NOT list_contains({_STOP}, term)),
terms AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM words) WHERE term IN (SELECT term FROM asked) GROUP BY ALL), idf AS (SELECT term, count(*) AS df FROM terms GROUP BY term),
sc AS (SELECT a.item_id AS query_id, t.doc_id AS chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * CAST(2.2 AS DOUBLE) / (tf + CAST(1.2 AS DOUBLE) * (0.25 + 0.75 * len / al))), 6) AS score FROM asked a JOIN terms t USING (term) JOIN idf USING (term), st GROUP BY ALL),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank, chunk_id, score FROM sc) SELECT query_id, rank, round(score, 3) AS score FROM r WHERE rank <= 12""")(
    lambda spark, d: V.bm25(X.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), X.table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")).select("query_id", "rank", F.round("score", 3).alias("score"))
)
query("cosine_block_join", "WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT x.vec_id AS query_id, y.vec_id AS candidate_id, round(list_dot_product(x.e, y.e), 5) AS similarity FROM v x JOIN v y ON x.label = y.label AND x.vec_id % 5 = 0 AND y.vec_id % 5 <> 0 WHERE round(list_dot_product(x.e, y.e), 5) >= 0.25")(
    lambda spark, d: V.cosine_block_join(*X.semantic(spark, d)[:2], threshold=0.25)
)
_FIRST = f"WITH {Q.TURNS} "
query("list_threads", _FIRST + "SELECT user_id, session_id, arg_min(query, turn_id) AS title, count(*) AS turn_count, min(minute_no) AS created, max(minute_no) AS updated FROM (SELECT * FROM turns QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY minute_no DESC, turn_id DESC) <= 10) GROUP BY ALL")(lambda spark, d: H.list_threads(X.turns(spark, d), 10))
query("latest_turns", _FIRST + "SELECT user_id, turn_id FROM turns QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY minute_no DESC, turn_id DESC) <= 5")(lambda spark, d: H.latest_turns(X.turns(spark, d), 5).select("user_id", "turn_id"))
query("thread_documents", _FIRST + "SELECT session_id, arg_min(query, turn) AS title, min(minute_no) AS created, string_agg(concat(turn_id, ':', query), '|' ORDER BY turn) AS turns FROM turns GROUP BY session_id")(
    lambda spark, d: H.thread_documents(X.turns(spark, d)).withColumn("turns", F.array_join(F.transform("turns", lambda t: F.concat(t["turn_id"], F.lit(":"), t["query"])), "|"))
)
query("history_text", _FIRST + """, s AS (SELECT *, concat('User: ', trim(query), chr(10), 'Assistant: ', CASE WHEN len(trim(answer_raw)) > 600 THEN concat(rtrim(substr(trim(answer_raw), 1, 600)), '…') ELSE trim(answer_raw) END) AS said FROM turns)
SELECT turn_id, coalesce(string_agg(said, chr(10)) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), '') AS history FROM s""".replace("WITH p AS", "WITH p AS"))(lambda spark, d: H.history_text(X.turns(spark, d)))
query("recent_searches", _FIRST + ", o AS (SELECT * FROM turns QUALIFY row_number() OVER (PARTITION BY user_id, lower(query) ORDER BY minute_no DESC, turn_id DESC) = 1) SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY minute_no DESC, turn_id DESC) AS INT) AS n, query FROM o QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY minute_no DESC, turn_id DESC) <= 10")(lambda spark, d: H.recent_searches(X.turns(spark, d)))
query("purge_threads", _FIRST + "SELECT turn_id FROM turns WHERE session_id NOT IN (SELECT session_id FROM turns WHERE session_id % 3 = 0 AND user_id % 2 = 0)")(
    lambda spark, d: (lambda t: H.purge_threads(t, t.select("session_id", "user_id").distinct(), t.where("session_id % 3 = 0").select("session_id", (F.col("user_id") - F.col("user_id") % 2).alias("user_id")))[0].select("turn_id"))(X.turns(spark, d))
)
query("export_threads_md")(lambda spark, d: H.export_threads_md(X.turns(spark, d), X.sources(spark, d)))
query("with_user_name", "SELECT c.conv_id, c.turn, coalesce(u.c_name, '') AS preferred_name FROM conversations c LEFT JOIN customer u ON u.c_custkey = c.conv_id")(
    lambda spark, d: H.with_user_name(X.table(spark, d, "conversations").select("conv_id", "turn", F.col("conv_id").alias("user_id")), X.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("preferred_name"))).select("conv_id", "turn", "preferred_name")
)
