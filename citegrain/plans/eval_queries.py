"""Queries over evaluation reports, baselines and stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..operators import evals as E
from ..operators import trace as S
from ..storage import scratch, stored
from . import relations_sql as Q
from .catalog import query
from .corpus_queries import _SCORES, _SUMMARY, _runs


def _report(spark, d):
    scores = stored(E.score_runs(_runs(spark, d)), "scores")
    summary = stored(E.summarize(scores), "summary")
    baseline = spark.sql("SELECT 0.95D AS mean_coverage, 0.5D AS mean_utilization, 1.0D AS format_compliance_rate, 0.3D AS triage_format_match_rate")
    failed = E.hard_failures(scores, X.turns(spark, d).select("turn_id", F.lit(False).alias("allow_fallback")))
    return E.report_lines(summary, scores, E.compare_to_baseline(summary, baseline), failed, "2024-01-01")


_PCT = "concat(CAST(CAST(round_even({0} * 100, 0) AS INT) AS VARCHAR), '%')"
_PROBLEMS = """concat_ws('; ', CASE WHEN error <> '' THEN concat('run failed: ', error) END, CASE WHEN NOT answered THEN 'empty answer' END, CASE WHEN len(invalid) > 0 THEN concat('fabricated citation markers: [', array_to_string(invalid, ', '), ']') END,
  CASE WHEN len(missing_terms) > 0 THEN concat('missing required terms: ', array_to_string(missing_terms, ', ')) END)"""
query("eval_report_lines", f"""WITH {_SCORES}, {_SUMMARY}, problems AS (SELECT turn_id, {_PROBLEMS} AS p FROM scores),
regressed AS (SELECT * FROM (SELECT unnest(['mean_coverage', 'mean_utilization', 'format_compliance_rate', 'triage_format_match_rate']) AS metric, unnest([0.95, 0.5, 1.0, 0.3]::DOUBLE[]) AS before, unnest([mean_coverage, mean_utilization, format_compliance_rate, triage_format_match_rate]::DOUBLE[]) AS after,
  unnest([0.1, 0.1, 0.15, 0.15]::DOUBLE[]) AS tolerance FROM summary) WHERE after < before - tolerance),
h AS (SELECT [concat('# Eval run — ', CASE WHEN (SELECT count(*) FROM problems WHERE p <> '') + (SELECT count(*) FROM regressed) = 0 THEN 'PASS' ELSE 'FAIL' END), '', printf('_2024-01-01 · %d queries · $%.4f · %.1fs mean_', queries, total_cost_usd, mean_latency_ms / 1000), '', '| Metric | Value |', '| --- | --- |',
  concat('| Fabricated citations | **', total_invalid_citations, '** |'), concat('| Citation coverage | ', {_PCT.format('mean_coverage')}, ' |'), concat('| Source utilization | ', {_PCT.format('mean_utilization')}, ' |'), concat('| Format compliance | ', {_PCT.format('format_compliance_rate')}, ' |'),
  concat('| Triage format match | ', {_PCT.format('triage_format_match_rate')}, ' |'), concat('| Mean sources | ', printf('%.1f', round_even(mean_sources, 1)), ' |'), concat('| Mean top rerank score | ', printf('%.3f', round_even(mean_top_rerank_score, 3)), ' |'), concat('| Errored runs | ', errors, ' |'), ''] AS x FROM summary),
titles(section, x) AS (SELECT 2, ['## Regressions', ''] WHERE EXISTS (FROM regressed) UNION ALL SELECT 3, ['## Hard failures', ''] WHERE EXISTS (SELECT 1 FROM problems WHERE p <> '')
  UNION ALL SELECT 4, ['## Per query', '', '| Query | Mode | Format | Cov | Util | Cites | Latency | Cost |', '| --- | --- | --- | --- | --- | --- | --- | --- |'] UNION ALL SELECT 1, x FROM h)
SELECT section, CAST(i - 1 AS INT) AS place, CAST(NULL AS VARCHAR) AS id, x[i] AS line FROM (SELECT *, unnest(generate_series(1, len(x))) AS i FROM titles)
UNION ALL SELECT 2, 2, metric, concat('- ', metric, ': ', printf('%.2f%%', round_even(after * 100, 2)), ' vs baseline ', printf('%.2f%%', round_even(before * 100, 2)), ' (tolerance ', {_PCT.format('tolerance')}, ')') FROM regressed
UNION ALL SELECT 3, 2, CAST(turn_id AS VARCHAR), concat('- **', turn_id, '** — ', p) FROM problems WHERE p <> ''
UNION ALL SELECT 4, 4, CAST(turn_id AS VARCHAR), concat('| ', turn_id, ' | ', coalesce(nullif(mode, ''), '—'), ' | ', coalesce(nullif(declared, ''), '—'), CASE WHEN coalesce(format_ok, true) THEN '' ELSE ' ⚠' END, ' | ', {_PCT.format('coalesce(coverage, 0)')}, ' | ', {_PCT.format('coalesce(utilization, 0)')}, ' | ',
  CASE WHEN len(invalid) > 0 THEN CAST(len(invalid) AS VARCHAR) ELSE '' END, ' | ', printf('%.1fs', round_even(coalesce(latency_ms, 0) / 1000, 1)), ' | ', printf('$%.5f', coalesce(cost_usd, 0)), ' |') FROM scores""")(_report)


def _baseline(spark, d):
    """An older baseline is replaced, and a run that is repeated leaves what there is."""
    summary = stored(E.summarize(E.score_runs(_runs(spark, d))), "summary")
    path = scratch(spark, "baseline")
    for row in (summary.withColumn("mean_coverage", F.lit(0.5)), summary, summary):
        E.update_baseline(row, path)
    n = spark.read.parquet(f"{path}/versions/*").count()
    return E.read_baseline(spark, path).withColumn("versions", F.lit(n).cast("long"))


query("baseline_read_back", f"WITH {_SCORES}, {_SUMMARY} SELECT *, CAST(2 AS BIGINT) AS versions FROM summary")(_baseline)
query("eval_spec_histories", """SELECT CAST(item_id AS VARCHAR) AS id, 'malformed history' AS problem FROM benchmark WHERE item_id % 7 IN (2, 4, 5)""")(
    lambda spark, d: E.load_specs(X.table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.coalesce(F.nullif(F.trim("text"), F.lit("")), F.lit("?")).alias("query"), F.lit("table").alias("expected_format"), F.expr(
        """CASE item_id % 7 WHEN 1 THEN '[{"query": null}, {"query": "b", "answer": 1}]' WHEN 2 THEN '[{"answer": "x"}]' WHEN 3 THEN ' [] ' WHEN 4 THEN '{"query": "x"}' WHEN 5 THEN '["query"]' WHEN 6 THEN '' END""").alias("history")))[1]
)


def _sketched(spark, d):
    """Whether each stage's sketched percentile has a rank within its error."""
    spans = X.table(spark, d, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("duration"), (F.col("value") > 20).alias("failed"))
    told = S.stage_latency(spans, accuracy=200)
    ranks = spans.join(F.broadcast(told.select("stage", "p95", "n")), "stage").groupBy("stage").agg(F.count(F.when(F.col("duration") < F.col("p95"), 1)).alias("below"), F.count(F.when(F.col("duration") <= F.col("p95"), 1)).alias("upto"), F.max("n").alias("n"))
    off = F.col("n") / 200 + 1
    within = ranks.select("stage", ((F.col("below") <= F.col("n") * 0.95 + off) & (F.col("upto") >= F.col("n") * 0.95 - off)).alias("within"))
    return told.drop("p95").join(within, "stage")


query("stage_latency_sketch", "SELECT event_type AS stage, count(*) AS n, round(avg(value), 4) AS mean, max(value) AS highest, round(avg(CASE WHEN value > 20 THEN 1 ELSE 0 END), 4) AS error_rate, true AS within FROM events GROUP BY event_type")(_sketched)
query("stage_outputs", f"""WITH {Q.ANSWERS}, s AS (SELECT *, unnest(['triage', 'search', 'rerank', 'synthesize', 'chat']) AS stage FROM answers)
SELECT turn_id, stage, CASE WHEN stage = 'triage' AND turn_id % 5 > 0 THEN 'research' END AS mode, CASE WHEN stage = 'triage' THEN turn_id % 3 END AS sub_queries, CASE WHEN stage = 'triage' AND turn_id % 2 = 0 THEN 'table' END AS answer_format, CASE WHEN stage = 'triage' THEN turn_id % 2 = 0 END AS needs_web,
  CASE WHEN stage = 'search' THEN n_sources END AS sources, CASE WHEN stage = 'search' THEN 2 * n_sources END AS chunks, CAST(CASE WHEN stage = 'search' THEN CASE WHEN turn_id % 3 = 0 THEN 2 ELSE 0 END END AS BIGINT) AS document_chunks, CAST(CASE WHEN stage = 'search' THEN CASE WHEN turn_id % 4 = 0 THEN 1 ELSE 0 END END AS BIGINT) AS images,
  CAST(CASE WHEN stage = 'rerank' THEN turn_id % 2 END AS BIGINT) AS ranked_chunks, CASE WHEN stage = 'rerank' THEN CASE WHEN turn_id % 2 = 1 THEN round(turn_id % 10 / CAST(7 AS DOUBLE), 4) ELSE 0 END END AS top_score, CAST(CASE WHEN stage IN ('synthesize', 'chat') THEN len(answer) END AS BIGINT) AS answer_chars,
  CAST(CASE WHEN stage = 'synthesize' THEN 2 END AS BIGINT) AS citations, CAST(CASE WHEN stage = 'synthesize' THEN CASE WHEN turn_id % 4 = 0 THEN 3 ELSE 0 END END AS BIGINT) AS invalid_citations, CASE WHEN stage = 'synthesize' THEN CAST(0.5 AS DOUBLE) END AS confidence, CAST(CASE WHEN stage = 'synthesize' THEN 0 END AS BIGINT) AS follow_ups FROM s""")(
    lambda spark, d: S.stage_outputs(X.answers(spark, d).selectExpr(
        "turn_id", "explode(array('triage', 'search', 'rerank', 'synthesize', 'chat', 'other')) AS stage", "CASE WHEN turn_id % 5 > 0 THEN 'research' END AS mode", "slice(array('a', 'b'), 1, CAST(turn_id % 3 AS INT)) AS sub_queries", "CASE WHEN turn_id % 2 = 0 THEN named_struct('type', 'table') END AS answer_format",
        "turn_id % 2 = 0 AS needs_web", "sequence(1L, n_sources) AS search_results", "sequence(1L, 2 * n_sources) AS scraped_content", "CASE WHEN turn_id % 3 = 0 THEN array('a', 'b') END AS document_chunks", "CASE WHEN turn_id % 4 = 0 THEN array('i') END AS images",
        "CASE WHEN turn_id % 2 = 1 THEN array(named_struct('score', turn_id % 10 / 7D)) ELSE array() END AS ranked_chunks", "answer AS draft_answer", "array(1, 2) AS citations", "CASE WHEN turn_id % 4 = 0 THEN 3 END AS invalid_citations", "0.5D AS confidence"))
)
