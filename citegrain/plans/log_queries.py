"""Queries over ingested logs, plans, scalar functions and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import text as T
from ..operators import citations as C
from ..operators import plan_log as P
from ..operators import retrieval as V
from ..operators import reuse as R
from ..operators import trace as S
from ..operators import usage as U
from ..sources import ingest as I
from ..storage import scratch, stored, written
from ..streaming import events as K
from ..streaming import turns as N
from . import relations_sql as Q
from .answer_queries import _FOLD, _REUSE
from .catalog import query


def _search_log(spark, d):
    rows = X.ranked(spark, d).selectExpr("turn_id AS query_id", "position", "named_struct('url', CASE WHEN position % 7 = 0 THEN '' ELSE source_url END, 'title', CASE WHEN position % 5 = 0 THEN '' ELSE concat('T', position) END, 'raw_content', CASE WHEN position % 2 = 0 THEN text ELSE '' END, 'content', concat('excerpt ', text)) AS r")
    return rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "r"))), lambda x: x["r"]).alias("results"))


_DOM = "replace(regexp_extract({0}, '^https://([^/]*)', 1), 'www.', '')"
query("normalize_search", f"""WITH {Q.TURNS}, {Q.RANKED} SELECT turn_id AS query_id, CAST(position - 1 AS INT) AS position, source_url AS url, concat('T', position) AS title, {_DOM.format('source_url')} AS domain, substr(concat('excerpt ', text), 1, 300) AS snippet,
  substr(CASE WHEN position % 2 = 0 AND text <> '' THEN text ELSE concat('excerpt ', text) END, 1, 12000) AS content, concat('https://www.google.com/s2/favicons?domain=', {_DOM.format('source_url')}, '&sz=32') AS favicon FROM ranked WHERE position % 7 <> 0 AND position % 5 <> 0""")(lambda spark, d: V.normalize_search(_search_log(spark, d)))
query("normalize_images", f"WITH {Q.TURNS}, {Q.RANKED} SELECT turn_id AS query_id, CAST(position - 1 AS INT) AS position, concat(source_url, '.png') AS image, CASE WHEN position % 2 = 0 THEN 'thumb' ELSE concat(source_url, '.png') END AS thumbnail, CASE WHEN position % 4 = 0 THEN 'src' ELSE {_DOM.format('source_url')} END AS domain FROM ranked WHERE position % 3 <> 0")(
    lambda spark, d: V.normalize_images(X.ranked(spark, d).groupBy(F.col("turn_id").alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "source_url"))), lambda x: F.struct(
        F.when(x["position"] % 3 == 0, "").otherwise(F.concat(x["source_url"], F.lit(".png"))).alias("image"), F.when(x["position"] % 2 == 0, "thumb").otherwise("").alias("thumbnail"), F.when(x["position"] % 4 == 0, "src").otherwise("").alias("source"), x["source_url"].alias("url"))).alias("images")))
)
query("extract_pages")(lambda spark, d: I.extract_pages(X.table(spark, d, "pages")))
query("extract_stats")(lambda spark, d: V.extract_stats(I.extract_pages(X.table(spark, d, "pages"))))
query("incremental_extract", "SELECT url FROM pages WHERE page_id % 3 <> 0 AND url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")(
    lambda spark, d: (lambda p: V.incremental_extract(p.select("url"), p.where("page_id % 3 = 0").select("url"))[0])(X.table(spark, d, "pages"))
)
query("ingest_files", "SELECT concat('doc', doc_id, '.txt') AS name, 'text/plain' AS mime, CASE WHEN len(trim(text)) > 12000 THEN 12000 + len(concat(chr(10), chr(10), '[...truncated at 12000 chars]')) ELSE len(trim(text)) END AS n_chars FROM documents WHERE strlen(text) <= 5242880")(
    lambda spark, d: I.extract_files(X.table(spark, d, "documents").select(F.concat(F.lit("/in/doc"), F.col("doc_id"), F.lit(".txt")).alias("path"), F.octet_length("text").cast("long").alias("length"), F.encode("text", "utf-8").alias("content"))).where("n_chars IS NOT NULL").select("name", "mime", F.col("n_chars").cast("long").alias("n_chars"))
)
query("typed_turns", f"WITH {Q.TURNS}, {Q.SOURCES} SELECT turn_id, count(*) AS n_kept, string_agg(url, ',' ORDER BY idx) AS domains FROM sources GROUP BY turn_id")(
    lambda spark, d: I.typed_turns(X.sources(spark, d).groupBy("turn_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("idx", "url", "title"))), lambda s: F.struct(s["url"].alias("url"), s["title"].alias("title")))).alias("sources"))).select("turn_id", F.size("sources").cast("long").alias("n_kept"), F.array_join(F.transform("sources", lambda s: s["domain"]), ",").alias("domains"))
)
query("validate_requests", "SELECT doc_id, concat_ws(',', CASE WHEN len(text) < 1 OR len(text) > 2000 THEN 'query length' END, CASE WHEN doc_id % 8 NOT BETWEEN 1 AND 5 THEN 'iterations' END) AS reasons FROM documents WHERE len(text) < 1 OR len(text) > 2000 OR doc_id % 8 NOT BETWEEN 1 AND 5")(
    lambda spark, d: I.validate_requests(X.table(spark, d, "documents").select("doc_id", F.col("text").alias("query"), (F.col("doc_id") % 8).alias("iterations")))[1].select("doc_id", F.array_join("reasons", ",").alias("reasons"))
)
query("parse_sse", "SELECT event_id, event_type AS type, concat('{\"v\": ', event_id, '}') AS payload FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0")(
    lambda spark, d: I.parse_sse(X.table(spark, d, "events").selectExpr("event_id", "concat(CASE WHEN event_id % 5 = 0 THEN '' ELSE concat('event: ', event_type, '\\n') END, 'data: ', CASE WHEN event_id % 7 = 0 THEN '{broken' ELSE concat('{\"v\": ', event_id, '}') END, '\\n\\n') AS value"), "event_id").select("event_id", "type", "payload")
)


def _plans(spark, d):
    raw = """CASE turn_id % 3 WHEN 0 THEN concat('Sure: {"mode": "', CASE WHEN turn_id % 2 = 0 THEN 'chat' ELSE 'research' END, '", "sub_queries": [" a ", "A", "", "b"], "answer_format": {"type": "Table", "columns": ["x", " "]}} ok')
        WHEN 1 THEN '{"mode": "chat", "sub_queries": ["only"], "answer_format": {"type": "poem"}, "time_sensitive": false, "needs_web": false, "follow_ups": ["f1", " ", "f2"]}' ELSE 'no json' END"""
    return X.turns(spark, d).selectExpr("turn_id", "query", f"{raw} AS raw")


query("parse_plans", f"""WITH {Q.TURNS} SELECT turn_id, CASE turn_id % 3 WHEN 0 THEN CASE WHEN turn_id % 2 = 0 THEN 'chat' ELSE 'research' END WHEN 1 THEN 'chat' ELSE 'research' END AS mode,
  CASE turn_id % 3 WHEN 0 THEN 'a|b' WHEN 1 THEN concat('only|', query) ELSE query END AS sub_queries, CASE WHEN turn_id % 3 = 0 THEN 'table' ELSE 'prose' END AS format, CASE WHEN turn_id % 3 = 0 THEN 'x' ELSE '' END AS columns, turn_id % 3 <> 1 AS time_sensitive, true AS web, CASE WHEN turn_id % 3 = 1 THEN 'f1|f2' ELSE '' END AS follow_ups FROM turns""")(
    lambda spark, d: P.parse_plans(_plans(spark, d)).withColumns({c: F.array_join(c, "|") for c in ("sub_queries", "columns", "follow_ups")})
)
query("done_record", f"""WITH {Q.TURNS} SELECT turn_id, n_sources AS total_sources, round(CAST(least(0.9, 0.5 + 0.08 * n_sources) AS DOUBLE), 2) AS confidence, turn_id % 900 AS latency_ms, turn_id % 4 = 0 AS cached, CASE WHEN turn_id % 4 = 0 THEN 'exact' END AS cache_kind, CASE WHEN turn_id % 4 = 0 THEN 0 ELSE turn_id % 700 END AS total_tokens FROM turns""")(
    lambda spark, d: P.done_record(X.turns(spark, d).select("turn_id", "n_sources", (F.col("turn_id") % 900).alias("latency_ms"), F.when(F.col("turn_id") % 4 == 0, "exact").alias("kind"), F.lit(None).cast("string").alias("matched_query"), F.lit(None).cast("double").alias("similarity"), (F.col("turn_id") % 700).alias("total_tokens"), F.lit(0.1).alias("cost_usd"))).drop("matched_query", "similarity", "cost_usd")
)
query("cacheable_answers", f"WITH {Q.ANSWERS} SELECT turn_id, CASE WHEN turn_id % 2 = 0 THEN 900 ELSE 21600 END AS ttl_s FROM answers WHERE turn_id % 3 <> 0 AND trim(answer) <> ''")(
    lambda spark, d: X.answers(spark, d).where(R.is_cacheable(F.array().cast("array<string>"), F.when(F.col("turn_id") % 3 == 0, "failed"), F.col("answer"), F.array("n_sources"))).select("turn_id", R.ttl_for(F.col("turn_id") % 2 == 0).alias("ttl_s"))
)
query("answer_key_classes", f"WITH {Q.QUESTIONS} SELECT trim(regexp_replace(lower(question), '\\s+', ' ', 'g')) AS question, item_id % 3 AS who, count(*) AS n FROM questions GROUP BY ALL")(
    lambda spark, d: X.questions(spark, d).select(R.answer_key(F.concat(F.lit("  "), F.upper("question")), (F.col("item_id") % 3).cast("string"), F.lit("m"), F.lit(None).cast("array<struct<query:string,answer:string>>")).alias("k"), T.norm_question(F.col("question")).alias("question"), (F.col("item_id") % 3).alias("who")).groupBy("k").agg(F.first("question").alias("question"), F.first("who").alias("who"), F.count(F.lit(1)).alias("n")).drop("k")
)
query("bucket_keys", "SELECT label, substr(sha256(concat_ws('|', 'v1', CAST(label AS VARCHAR), 'm')), 1, 16) AS bucket, count(*) AS n FROM embeddings GROUP BY ALL")(lambda spark, d: X.table(spark, d, "embeddings").select("label", R.bucket_key(F.col("label").cast("string"), F.lit("m")).alias("bucket")).groupBy("label", "bucket").agg(F.count(F.lit(1)).alias("n")))
query("vectors", "SELECT vec_id, round(CASE WHEN list_sum(list_transform(e, lambda x: x * x)) > 0 THEN list_dot_product(e, e) / sqrt(list_dot_product(e, e)) END, 4) AS norm, list_sum(list_transform(e, lambda x: CAST(round(x * 2, 0) AS DOUBLE))) AS steps FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)")(
    lambda spark, d: X.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e")).select("vec_id", F.round(R.cosine(R.normalize_vector(F.col("e")), F.col("e")), 4).alias("norm"), F.aggregate(F.transform("e", lambda x: F.round(x * 2, 0)), F.lit(0.0), lambda s, x: s + x).alias("steps"))
)
query("url_functions", "SELECT page_id, replace(regexp_extract(coalesce(url, ''), '^[a-z]+://([^/?#]*)', 1), 'www.', '') AS domain, concat('page:', md5(coalesce(url, ''))) AS key, CASE WHEN regexp_matches(trim(url), '(?i)^https?://') THEN trim(url) ELSE '' END AS safe FROM pages")(
    lambda spark, d: X.table(spark, d, "pages").select("page_id", F.coalesce(T.url_domain(F.col("url")), F.lit("")).alias("domain"), R.url_key("page", F.col("url")).alias("key"), T.safe_url(F.col("url")).alias("safe"))
)
query("name_functions", """SELECT doc_id, CASE WHEN s = '' THEN 'session' ELSE s END AS slug, CASE WHEN trim(f) = '' THEN 'file' ELSE f END AS name FROM (
  SELECT doc_id, substr(regexp_replace(regexp_replace(lower(t), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 60) AS s, replace(replace(replace(replace(t, chr(13), ''), chr(10), ''), chr(34), ''), chr(92), '') AS f FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))""")(
    lambda spark, d: X.table(spark, d, "documents").select("doc_id", T.slug(F.col("text")).alias("slug"), T.safe_filename(F.col("text")).alias("name"))
)
query("plain_text", f"WITH {Q.ANSWERS} SELECT turn_id, regexp_replace(answer, '\\[\\d+\\]', '', 'g') AS plain FROM answers")(lambda spark, d: X.answers(spark, d).select("turn_id", T.clean_inline(F.col("answer")).alias("plain")))
query("doc_first", f"WITH {Q.TURNS}, {Q.RANKED} SELECT turn_id, CAST(row_number() OVER (PARTITION BY turn_id ORDER BY position % 2, position) AS INT) AS place, text, CASE WHEN position % 2 = 0 THEN 1.0 ELSE score END AS score FROM ranked")(
    lambda spark, d: (lambda r: V.doc_first(r.where("position % 2 = 0"), r.where("position % 2 = 1")))(X.ranked(spark, d))
)
query("rerank_on_error", f"WITH {Q.TURNS}, {Q.RANKED} SELECT turn_id AS query_id, CAST(row_number() OVER (PARTITION BY turn_id ORDER BY position) AS INT) AS rank, position AS chunk_id, CAST(0.5 AS DOUBLE) AS score FROM ranked QUALIFY row_number() OVER (PARTITION BY turn_id ORDER BY position) <= 12")(
    lambda spark, d: V.rerank(X.ranked(spark, d).select(F.col("turn_id").alias("query_id"), F.col("position").alias("chunk_id"), F.lit(None).cast("double").alias("score")))
)
query("cap_sources", f"WITH {Q.TURNS}, {Q.SOURCES} SELECT * FROM sources WHERE idx <= 5")(lambda spark, d: V.cap_sources(X.sources(spark, d), 5))
query("doc_sources", f"WITH {Q.TURNS}, t AS (SELECT *, CAST(1 + len(answer_raw) % 7 AS BIGINT) AS nc FROM turns WHERE trim(answer_raw) <> ''), b AS (SELECT *, coalesce(sum(nc) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t), s AS (SELECT *, coalesce(sum(CASE WHEN before >= 4 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM b) SELECT session_id AS turn_id, turn AS position, CAST(greatest(least(nc, 4 - before), 0) AS BIGINT) AS chunks_taken FROM s WHERE spent = 0")(
    lambda spark, d: V.doc_sources(X.turns(spark, d).select(F.col("session_id").alias("turn_id"), F.col("turn").alias("position"), F.lit("f").alias("name"), F.col("answer_raw").alias("text"), (1 + F.length("answer_raw") % 7).cast("long").alias("n_chunks")), budget=4).select("turn_id", "position", "chunks_taken")
)
query("price_calls_unknown", f"WITH {Q.CALLS} SELECT count(*) AS calls, count(CASE WHEN model <> 'unpriced' THEN 1 END) AS priced FROM calls")(lambda spark, d: U.price_calls(X.llm_calls(spark, d), X.prices(spark), unknown="null").agg(F.count(F.lit(1)).alias("calls"), F.count("cost_usd").alias("priced")))
query("purge_stale_index", "SELECT vec_id FROM embeddings WHERE vec_id % 7 IN (SELECT CAST(n_nationkey AS BIGINT) FROM nation WHERE n_nationkey < 4)")(lambda spark, d: R.purge_stale_index(X.table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 7).alias("key")), X.table(spark, d, "nation").where("n_nationkey < 4").select(F.col("n_nationkey").cast("long").alias("key"))).select("vec_id"))

_LISTED = f"""{Q.ANSWERS}, {Q.SOURCES}, n AS (SELECT turn_id, count(*) AS n_sources FROM sources GROUP BY turn_id)"""
query("fold_events", f"WITH {_LISTED} SELECT turn_id, answer, n.n_sources FROM answers JOIN n USING (turn_id)")(lambda spark, d: N.fold_events(N.replay_events(X.answers(spark, d), X.sources(spark, d))))
query("replay_events", f"WITH {_LISTED} SELECT turn_id, CAST(i AS INT) AS seq, t AS type FROM (SELECT turn_id, unnest(generate_series(0, len(l) - 1)) AS i, unnest(l) AS t FROM (SELECT turn_id, list_filter([CASE WHEN query <> '' THEN 'sub_queries' END, 'sources', 'phase', 'token', 'done'], lambda x: x IS NOT NULL) AS l FROM answers))")(
    lambda spark, d: N.replay_events(X.answers(spark, d), X.sources(spark, d)).select("turn_id", "seq", "type")
)
query("replay_stored_turns", f"""WITH {Q.ANSWERS}, {Q.SOURCES}, s AS (SELECT turn_id, list({{'idx': idx, 'url': url, 'title': title}} ORDER BY idx) AS s FROM sources GROUP BY turn_id), l AS (
  SELECT turn_id, list_filter([
    CASE WHEN turn_id % 2 = 0 THEN {{'type': 'sub_queries', 'payload': CAST(to_json({{'queries': [query, concat(query, ' in detail')]}}) AS VARCHAR)}} END,
    {{'type': 'sources', 'payload': CAST(to_json({{'sources': s, 'replace': true}}) AS VARCHAR)}},
    CASE WHEN turn_id % 4 <> 1 THEN {{'type': 'images', 'payload': CAST(to_json({{'images': [{{'image': concat('https://i.example.com/', turn_id, '.png'), 'domain': 'i.example.com'}}]}}) AS VARCHAR)}} END,
    {{'type': 'phase', 'payload': '{{"phase":"writing","message":"Synthesizing your answer..."}}'}}, {{'type': 'token', 'payload': CAST(to_json({{'token': answer}}) AS VARCHAR)}},
    CASE WHEN turn_id % 5 < 3 OR turn_id % 3 = 0 THEN {{'type': 'trace', 'payload': concat('{{"sources":', CASE WHEN turn_id % 5 < 3 THEN to_json([{{'url': concat('https://t.example.com/', turn_id), 'chunks': 2}}]) ELSE '[]' END, ',"sub_queries":', CASE WHEN turn_id % 3 = 0 THEN to_json([query]) ELSE '[]' END, '}}')}} END,
    CASE WHEN turn_id % 3 <> 2 THEN {{'type': 'follow_up', 'payload': CAST(to_json({{'suggestions': [concat('more on ', turn_id), 'why']}}) AS VARCHAR)}} END, {{'type': 'done', 'payload': concat('{{"id":', turn_id, '}}')}}
  ], lambda x: x IS NOT NULL) AS l FROM answers JOIN s USING (turn_id)
) SELECT turn_id, CAST(i - 1 AS INT) AS seq, l[i].type AS type, l[i].payload AS payload FROM (SELECT *, unnest(generate_series(1, len(l))) AS i FROM l)""")(lambda spark, d: N.replay_events(X.stored_turns(spark, d), X.sources(spark, d)))


def _shown(turns):
    urls = F.array_join(F.transform("sources", lambda s: s["url"]), ",")
    return turns.select("turn_id", "answer", urls.alias("urls"), "images", "trace", F.coalesce(F.array_join("follow_ups", "|"), F.lit("")).alias("follow_ups"), "error")


def _turns_stream(spark, d):
    """The live log in four runs that share their state, events dealt by a hash; the last run also sees an event of much later."""
    log = stored(X.live_log(spark, d).withColumn("run", F.pmod(F.xxhash64("turn_id", "seq"), F.lit(4))), "live")
    later = log.sparkSession.sql("SELECT -1L AS turn_id, 0 AS seq, TIMESTAMP'2044-01-01' AS ts, 'phase' AS type, '{}' AS payload")
    folder, place = scratch(spark, "log"), scratch(spark, "turns")
    for run in range(4):
        part = log.where(F.col("run") == run).drop("run")
        (part.unionByName(later) if run == 3 else part).write.mode("append").parquet(folder)
        rows = K.run_available(N.fold_turns_stream(spark.readStream.schema(part.schema).parquet(folder), late="3000 days"), place=place)
    return rows


query("fold_turns", f"WITH {Q.LIVE} SELECT * FROM live")(lambda spark, d: _shown(N.fold_turns(X.live_log(spark, d))))
query("fold_turns_stream", f"WITH {Q.LIVE} SELECT * FROM live")(lambda spark, d: _shown(_turns_stream(spark, d)))
query("idle_turns", f"WITH {Q.LIVE} SELECT turn_id, error FROM live WHERE turn_id % 17 = 6 OR turn_id % 13 = 4")(lambda spark, d: N.fold_turns(X.live_log(spark, d)).where("error = 'timeout'").select("turn_id", "error"))


def _fold_stream(spark, d):
    events = N.replay_events(X.answers(spark, d), X.sources(spark, d)).withColumn("ts", F.expr("TIMESTAMP'2024-01-01' + make_dt_interval(0, 0, 0, seq)"))
    return K.run_available(N.fold_events_stream(spark.readStream.schema(events.schema).parquet(written(events, "log")))).where("error IS NULL").drop("error")


def _requests_stream(spark, d):
    requests = X.requests(spark, d)
    return K.reuse_stream(spark.readStream.schema(requests.schema).parquet(written(requests, "requests")))


query("fold_events_stream", f"WITH {_LISTED} SELECT turn_id, answer, n.n_sources FROM answers JOIN n USING (turn_id)")(_fold_stream)
query("rate_limit_stream", f"WITH {_FOLD} SELECT user_id, event_id, window_start, n, n > 2 AS exceeded FROM w")(
    lambda spark, d: K.run_available(K.rate_limit_stream(K.stream_of(spark, d, "events.parquet", X.table(spark, d, "events").schema).select("user_id", "event_id", "ts"), 86400, 2))
)
query("reuse_stream", f"WITH {_REUSE} SELECT event_id, kind, hit_id AS stored_event_id, CAST(floor(epoch(ts - hit_ts)) AS BIGINT) AS age_s FROM a")(lambda spark, d: K.run_available(_requests_stream(spark, d)))
query("cache_stats_stream", f"WITH {_REUSE} SELECT kind, count(*) AS n FROM a GROUP BY kind")(lambda spark, d: K.run_available(K.cache_stats_stream(spark.readStream.schema("event_id bigint, kind string, stored_event_id bigint, age_s bigint").parquet(written(R.reuse_attribution(X.requests(spark, d)), "kinds"))), "complete"))


def _usage_stream(spark, d):
    priced = U.price_calls(X.llm_calls(spark, d), X.prices(spark)).withColumn("ts", F.col("ts").cast("timestamp"))
    return K.run_available(K.usage_stream(spark.readStream.schema(priced.schema).parquet(written(priced, "calls"))), "complete").withColumn("day", F.col("day").cast("timestamp_ntz"))


query("usage_stream", f"WITH {Q.CALLS} SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, stage, count(*) AS calls, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, round(sum(cost_usd), 4) AS cost_usd FROM priced GROUP BY ALL")(_usage_stream)
query("confidence", f"WITH {Q.TURNS} SELECT turn_id, round(CAST(least(0.9, 0.5 + 0.08 * n_sources) AS DOUBLE), 2) AS confidence FROM turns")(lambda spark, d: X.turns(spark, d).select("turn_id", C.confidence(F.col("n_sources")).alias("confidence")))
query("trace_emptiness", f"WITH {Q.TURNS} SELECT turn_id, turn_id % 2 = 0 AND turn_id % 3 = 0 AS is_empty FROM turns")(
    lambda spark, d: X.turns(spark, d).select("turn_id", S.trace_is_empty(F.expr("CASE WHEN turn_id % 2 = 0 THEN array() ELSE array(turn_id) END"), F.expr("CASE WHEN turn_id % 3 = 0 THEN NULL ELSE array(query) END")).alias("is_empty"))
)
