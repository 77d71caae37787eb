"""Turns, answers, sources and logs derived from the conversation and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns that the assistant answered."""
    pairs = table(spark, sf_dir, "conversations").selectExpr(
        "conv_id", "turn", "role", "text",
        "lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nt", "lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nr",
    )
    return pairs.where("role = 'user' AND nr = 'assistant'").selectExpr(
        "conv_id * 100 + turn AS turn_id", "conv_id AS session_id", "conv_id % 17 AS user_id", "turn", "text AS query", "nt AS answer_raw",
        "1 + conv_id % 8 AS n_sources", "(conv_id * 100 + turn) % 4 AS fmt", "conv_id * 60 + turn * 5 AS minute_no",
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with an answer whose lines carry citation markers, some out of range."""
    line = """transform(split(answer_raw, '\\n'), (x, j) -> concat(
        CASE fmt WHEN 1 THEN '- ' WHEN 2 THEN concat(j + 1, '. ') WHEN 3 THEN '| ' ELSE '' END, x,
        CASE WHEN fmt = 3 THEN concat(' | [', 1 + ((j + 1) * 7 + session_id) % (n_sources + 2), '] |')
             WHEN (j + 1 + turn_id) % 3 <> 0 THEN concat(' [', 1 + ((j + 1) * 7 + session_id) % (n_sources + 2), ']') ELSE '' END))"""
    head = "CASE WHEN fmt = 3 THEN '| A | B |\\n| --- | --- |\\n' ELSE '' END"
    return turns(spark, sf_dir).withColumn("answer", F.expr(f"concat({head}, array_join({line}, '\\n'))"))


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with headings, inline marks and fences of both kinds, some nested and some never closed."""
    line = """transform(split(answer, '\\n'), (x, j) -> concat(
        CASE (turn_id + j * 3) % 11 WHEN 1 THEN '```\\n' WHEN 3 THEN ' ~~~ text\\n' WHEN 4 THEN '```\\n' WHEN 5 THEN '## ' WHEN 6 THEN '\\n\\n\\n' WHEN 7 THEN '1. ' WHEN 8 THEN '**bold** `code` _it_ [site](http://x.example) ' ELSE '' END, x))"""
    return answers(spark, sf_dir).select("turn_id", F.expr(f"array_join({line}, '\\n')").alias("answer"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).selectExpr("*", "explode(sequence(1L, n_sources)) AS k").selectExpr(
        "turn_id", "k AS idx", "concat('https://', CASE WHEN k % 3 = 0 THEN 'www.' ELSE '' END, 'site', (session_id + k) % 20, '.example.com/d/', session_id * 10 + k) AS url", "concat('Title ', k) AS title",
    )


def stored_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with sub-queries, images, a trace and follow-ups, each empty or missing for some."""
    return answers(spark, sf_dir).selectExpr(
        "turn_id", "query", "answer", "minute_no", "CASE WHEN turn_id % 2 = 0 THEN array(query, concat(query, ' in detail')) ELSE array() END AS sub_queries",
        "CASE WHEN turn_id % 4 <> 1 THEN array(named_struct('image', concat('https://i.example.com/', turn_id, '.png'), 'domain', 'i.example.com')) END AS images",
        """named_struct('sources', CASE WHEN turn_id % 5 < 3 THEN array(named_struct('url', concat('https://t.example.com/', turn_id), 'chunks', 2L)) ELSE array() END,
            'sub_queries', CASE WHEN turn_id % 3 = 0 THEN array(query) ELSE array() END) AS trace""",
        "CASE WHEN turn_id % 3 <> 2 THEN array(concat('more on ', turn_id), 'why') END AS follow_ups",
    )


def live_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of turns as they were answered: sources in two lists, images twice, tokens of sixty characters. Some
    turns fail, some never end, and some pause for an hour behind their third event."""
    listed = sources(spark, sf_dir).groupBy("turn_id").agg(F.array_sort(F.collect_list(F.struct("idx", "url", "title"))).alias("s"))
    event = lambda kind, json: f"named_struct('type', '{kind}', 'payload', {json})"
    events = f"""array_compact(flatten(array(
        array({event('sources', "to_json(named_struct('sources', filter(s, x -> x.idx % 2 = 1)))")}, {event('images', "'{\"images\":[\"first\"]}'")}),
        transform(sequence(1, greatest(length(answer), 1), 60), i -> {event('token', "to_json(named_struct('token', substr(answer, i, 60)))")}),
        array({event('sources', "CASE WHEN turn_id % 3 = 0 THEN to_json(named_struct('sources', s, 'replace', true)) ELSE to_json(named_struct('sources', s)) END")},
            {event('images', "to_json(named_struct('images', array(concat('last ', turn_id))))")}, {event('trace', "to_json(named_struct('turn', turn_id))")},
            {event('follow_up', "to_json(named_struct('suggestions', array(concat('more on ', turn_id), 'why')))")},
            CASE WHEN turn_id % 11 = 5 THEN {event('error', "'{}'")} END, CASE WHEN turn_id % 13 <> 4 THEN {event('done', "'{}'")} END))))"""
    rows = answers(spark, sf_dir).join(listed, "turn_id").select("turn_id", "minute_no", F.posexplode(F.expr(events)).alias("seq", "e"))
    begun = "TIMESTAMP'2024-01-01' + make_dt_interval(0, 0, minute_no, seq + CASE WHEN turn_id % 17 = 6 AND seq > 2 THEN 3600 ELSE 0 END)"
    return rows.selectExpr("turn_id", "seq", f"{begun} AS ts", "e.type", "e.payload")


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen scored passages for each turn, with ties and empty texts."""
    return turns(spark, sf_dir).selectExpr("*", "explode(sequence(1L, 16L)) AS p").selectExpr(
        "turn_id", "p AS position", "concat('https://site', 1 + (p * 5 + turn_id) % (n_sources + 3), '.example.com/d/', session_id) AS source_url",
        "CASE WHEN (p + turn_id) % 9 = 0 THEN '' ELSE substr(answer_raw, CAST(p * 20 AS INT), 60) END AS text",
        "CAST(CASE WHEN p <= 2 THEN 0.9 WHEN p <= 6 THEN 0.5 ELSE 0.1 END AS DOUBLE) AS score",
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", "user_id", "ts", "concat(event_type, ' topic ', CAST(get_json_object(props, '$.k') AS INT) % 7) AS query",
        "event_type IN ('error', 'view') AS time_sensitive", "value >= 5 AS cacheable",
    )


def llm_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "CAST(floor(event_id / 4.0) AS BIGINT) AS turn_id",
        "CASE event_id % 4 WHEN 0 THEN 'triage' WHEN 1 THEN 'synthesis' WHEN 2 THEN 'follow_ups' ELSE '' END AS stage",
        "CASE event_id % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'large' ELSE 'unpriced' END AS model",
        "CAST(floor(value * 10) AS BIGINT) AS prompt_tokens", "CAST(floor(value * 3) AS BIGINT) AS completion_tokens", "user_id", "ts",
    )


def prices(spark: SparkSession) -> DataFrame:
    """Prices in USD for a million tokens."""
    return spark.createDataFrame([("small", 0.05, 0.08), ("large", 0.59, 0.79)], "model string, prompt_usd double, completion_usd double")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight variants of each benchmark item."""
    variant = """trim(CASE v WHEN 0 THEN s WHEN 1 THEN concat('best ', s) WHEN 2 THEN concat('worst ', s) WHEN 3 THEN concat(s, ' 3.11')
        WHEN 4 THEN concat(s, ' 3.12') WHEN 5 THEN concat('explain ', s) WHEN 6 THEN concat('alpha vs beta ', s) ELSE concat('beta vs alpha ', s) END)"""
    return table(spark, sf_dir, "benchmark").selectExpr("item_id", "lower(text) AS s", "explode(sequence(0L, 7L)) AS v").selectExpr("item_id * 8 + v AS q_id", "item_id", f"{variant} AS question")


def semantic(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lookups, index, answers): vectors by bucket, each with a question, forty vectors to a benchmark item; some
    stored answers are stale, missing or blank."""
    asked = questions(spark, sf_dir).select("q_id", "question")
    n = asked.agg((F.max("q_id") + 1).alias("n"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("bucket"), F.col("embedding").cast("array<double>").alias("e"))
    rows = stored(rows.join(F.broadcast(n)).withColumn("q_id", F.expr("(vec_id div 40 * 8 + vec_id % 8) % n")).join(asked, "q_id").drop("q_id", "n"), "vectors")
    lookups = rows.where("vec_id % 5 = 0").withColumn("now", F.expr("1000 + vec_id % 50"))
    index = rows.where("vec_id % 5 <> 0").selectExpr("*", "vec_id AS key", "1000 - vec_id % 20 * 15 AS t", "vec_id % 4 = 0 AS time_sensitive")
    answers = index.where("vec_id % 7 <> 1").selectExpr("key", "CASE WHEN vec_id % 7 = 2 THEN ' ' ELSE question END AS answer")
    return lookups, index, answers
