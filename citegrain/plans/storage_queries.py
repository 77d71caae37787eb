"""Queries over stored turns and answers, threads, and embedded questions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import text as T
from ..operators import embed as B
from ..operators import evals as E
from ..operators import retrieval as V
from ..operators import reuse as R
from ..operators import threads as H
from ..sources import ingest as I
from ..storage import scratch
from . import relations_sql as Q
from .catalog import ORACLES, query


def _written_turns(spark, d):
    path = scratch(spark, "turns")
    made = X.turns(spark, d).selectExpr(
        "turn_id", "transform(sequence(1L, turn_id % 30 + 1), k -> named_struct('url', concat('u', k))) AS sources", "CASE WHEN turn_id % 3 > 0 THEN turn_id END AS total_tokens",
        "TIMESTAMP_NTZ'2024-01-01' + make_dt_interval(0, 0, CAST(minute_no AS INT)) AS created_at")
    I.write_turns(made, path)
    read = spark.read.parquet(path)
    return read.select("turn_id", F.size("sources").cast("long").alias("n_sources"), F.element_at("sources", -1)["url"].alias("last_url"), "total_tokens", F.col("day").cast("date").alias("day"))


query("write_turns_read_back", f"""WITH {Q.TURNS} SELECT turn_id, least(turn_id % 30 + 1, 20) AS n_sources, concat('u', least(turn_id % 30 + 1, 20)) AS last_url, CASE WHEN turn_id % 3 > 0 THEN turn_id ELSE 0 END AS total_tokens,
  CAST(TIMESTAMP '2024-01-01' + to_minutes(CAST(minute_no AS INT)) AS DATE) AS day FROM turns""")(_written_turns)


def _stored_by_day(spark, d):
    path = scratch(spark, "answers")
    R.store_answers(X.requests(spark, d).where("cacheable"), path)
    return spark.read.parquet(path).groupBy(F.col("day").cast("date").alias("day"), "ttl_s").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


query("stored_answers_by_day", f"WITH {Q.REQUESTS} SELECT CAST(ts AS DATE) AS day, CASE WHEN time_sensitive THEN 900 ELSE 21600 END AS ttl_s, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM requests WHERE cacheable GROUP BY ALL")(_stored_by_day)
_ONE, _FAILED = T.FALLBACKS[0].replace("'", "''"), T.FALLBACKS[2].replace("'", "''")
query("fallback_answers", f"""WITH {Q.ANSWERS}, a AS (SELECT turn_id, CASE turn_id % 9 WHEN 0 THEN concat('x ', '{_ONE}') WHEN 3 THEN '{_FAILED}' WHEN 4 THEN NULL ELSE answer END AS answer FROM answers)
SELECT turn_id, coalesce(contains(answer, '{_ONE}') OR contains(answer, '{_FAILED}'), false) AS fallback FROM a""")(
    lambda spark, d: X.answers(spark, d).select("turn_id", E.is_fallback(F.when(F.col("turn_id") % 9 == 0, F.lit("x " + T.FALLBACKS[0])).when(F.col("turn_id") % 9 == 3, T.FALLBACKS[2]).when(F.col("turn_id") % 9 != 4, F.col("answer"))).alias("fallback"))
)
query("newest_threads", f"""WITH {Q.TURNS}, t AS (SELECT user_id, session_id, max(minute_no) AS updated, count(*) AS turn_count FROM turns GROUP BY ALL)
SELECT user_id, session_id, turn_count, updated FROM t QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY updated DESC, session_id) <= 2""")(
    lambda spark, d: H.list_threads(X.turns(spark, d), 1_000_000, most=2).select("user_id", "session_id", "turn_count", "updated")
)
query("owned_threads", f"WITH {Q.TURNS} SELECT turn_id FROM turns WHERE session_id % 2 = 0 AND user_id IS NOT NULL")(
    lambda spark, d: (lambda t: H.owned_by(t, t.where("session_id % 2 = 0").select("session_id", "user_id").unionAll(t.where("session_id % 2 = 1").select("session_id", F.col("user_id") + 1)).distinct()).select("turn_id"))(X.turns(spark, d))
)
query("list_notes", f"WITH {Q.TURNS} SELECT user_id, turn_id AS note_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY minute_no DESC, turn_id) AS INT) AS n FROM turns")(
    lambda spark, d: H.list_notes(X.turns(spark, d).select("user_id", F.col("turn_id").alias("note_id"), F.col("minute_no").alias("updated"))).select("user_id", "note_id", "n")
)
query("strip_control", r"SELECT doc_id, substr(regexp_replace(concat(chr(7), left(text, 10), chr(31), text, chr(127)), '[\x00-\x1f\x7f]', '', 'g'), 1, 50) AS name, regexp_replace(concat(chr(7), left(text, 10), chr(31), text, chr(127)), '[\x00-\x08\x0b-\x1f\x7f]', '', 'g') AS text FROM documents")(
    lambda spark, d: X.table(spark, d, "documents").select("doc_id", F.concat(F.lit("\x07"), F.left("text", F.lit(10)), F.lit("\x1f"), F.col("text"), F.lit("\x7f")).alias("t")).select("doc_id", T.strip_control(F.col("t"), name=True).alias("name"), T.strip_control(F.col("t")).alias("text"))
)
query("concat_chunks", f"WITH {Q.TURNS}, {Q.RANKED} SELECT turn_id, position, text FROM ranked WHERE position <= 5 UNION ALL SELECT turn_id, position, text FROM ranked WHERE position > 3")(
    lambda spark, d: (lambda r: V.concat_chunks(r.where("position <= 5"), r.where("position > 3").select("text", "position", "turn_id")))(X.ranked(spark, d).select("turn_id", "position", "text"))
)
ORACLES["export_threads_md"] = f"""WITH {Q.TURNS}, {Q.SOURCES}, l AS (SELECT turn_id, string_agg(concat(idx, '. [', title, '](', url, ')'), chr(10) ORDER BY idx) AS listed FROM sources GROUP BY turn_id),
n AS (SELECT t.*, listed, row_number() OVER (PARTITION BY session_id ORDER BY turn) AS n FROM turns t LEFT JOIN l USING (turn_id)),
m AS (SELECT session_id, arg_min(query, turn) AS title, string_agg(concat('## Q', n, ': ', query, chr(10), chr(10), answer_raw, CASE WHEN listed IS NOT NULL THEN concat(chr(10), chr(10), '**Sources**', chr(10), listed) ELSE '' END), chr(10) || chr(10) ORDER BY n) AS parts FROM n GROUP BY session_id)
SELECT session_id, concat(CASE WHEN slug = '' THEN 'session' ELSE slug END, '.md') AS name, concat('# ', title, chr(10), chr(10), parts) AS markdown
FROM (SELECT *, substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 60) AS slug FROM m)"""


def letter_model():
    """A small model that SQL can tell as well: how often each letter stands in a text."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    return lambda texts: np.array([[t.count(c) for c in letters] for t in texts], float)


_LETTERS = "list_transform(str_split('abcdefghijklmnopqrstuvwxyz', ''), lambda c: CAST(len(question) - len(replace(question, c, '')) AS DOUBLE))"
query("embed_questions", f"WITH {Q.QUESTIONS}, v AS (SELECT q_id, {_LETTERS} AS v FROM questions) SELECT q_id, CAST(26 AS INT) AS n, round(v[1] / sqrt(list_dot_product(v, v)), 4) AS a, round(v[5] / sqrt(list_dot_product(v, v)), 4) AS e FROM v")(
    lambda spark, d: B.embed_questions(X.questions(spark, d).withColumn("question", F.concat(F.lit("  "), F.replace("question", F.lit(" "), F.lit("\n ")))), letter_model).select("q_id", F.size("e").alias("n"), F.round(F.get("e", F.lit(0)), 4).alias("a"), F.round(F.get("e", F.lit(4)), 4).alias("e"))
)


def length_model():
    """A small scorer that SQL can tell as well, and that fails on empty passages."""

    def score(queries, texts):
        if any(not t for t in texts):
            raise ValueError("empty passage")
        return np.array([[len(t) / (len(t) + len(q))] for q, t in zip(queries, texts)], float)

    return score


query("rerank_by_model", f"""WITH {Q.TURNS}, {Q.RANKED}, s AS (SELECT r.turn_id AS query_id, position AS chunk_id, CASE WHEN text <> '' THEN len(text) / CAST(len(text) + len(query) AS DOUBLE) ELSE 0.5 END AS score FROM ranked r JOIN turns t USING (turn_id)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank, chunk_id, round(score, 6) AS score FROM s) SELECT * FROM r WHERE rank <= 12""")(
    lambda spark, d: V.rerank(B.score_pairs(X.ranked(spark, d).join(X.turns(spark, d).select("turn_id", "query"), "turn_id").select(F.col("turn_id").alias("query_id"), F.col("position").alias("chunk_id"), "query", "text"), length_model)).withColumn("score", F.round("score", 6))
)
query("request_limits", """SELECT doc_id, concat_ws(',', CASE WHEN len(text) < 1 OR len(text) > 2000 THEN 'query length' END, CASE WHEN doc_id % 8 NOT BETWEEN 1 AND 5 THEN 'iterations' END, CASE WHEN doc_id % 25 > 20 THEN 'history length' END,
  CASE WHEN doc_id % 7 > 5 THEN 'documents' END, CASE WHEN len(text) * 3 > 16000 THEN 'document text length' END, CASE WHEN doc_id % 300 > 255 THEN 'name length' END, CASE WHEN len(text) * (doc_id % 5) < 1 OR len(text) * (doc_id % 5) > 10000 THEN 'note length' END) AS reasons
FROM documents WHERE len(text) < 1 OR len(text) > 2000 OR doc_id % 8 NOT BETWEEN 1 AND 5 OR doc_id % 25 > 20 OR doc_id % 7 > 5 OR len(text) * 3 > 16000 OR doc_id % 300 > 255 OR len(text) * (doc_id % 5) < 1 OR len(text) * (doc_id % 5) > 10000""")(
    lambda spark, d: I.validate_requests(X.table(spark, d, "documents").selectExpr(
        "doc_id", "text AS query", "doc_id % 8 AS iterations", "array_repeat('t', CAST(doc_id % 25 AS INT)) AS history", "array_repeat('d', CAST(doc_id % 7 AS INT)) AS documents", "repeat(text, 3) AS doc_text",
        "repeat('n', CAST(doc_id % 300 AS INT)) AS name", "repeat(text, CAST(doc_id % 5 AS INT)) AS note"))[1].select("doc_id", F.array_join("reasons", ",").alias("reasons"))
)
