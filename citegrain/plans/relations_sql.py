"""The derived relations as DuckDB common table expressions."""

TURNS = """p AS (
  SELECT conv_id, turn, role, text, lead(text) OVER w AS nt, lead(role) OVER w AS nr FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
), turns AS (
  SELECT conv_id * 100 + turn AS turn_id, conv_id AS session_id, conv_id % 17 AS user_id, turn, text AS query, nt AS answer_raw,
         1 + conv_id % 8 AS n_sources, (conv_id * 100 + turn) % 4 AS fmt, conv_id * 60 + turn * 5 AS minute_no
  FROM p WHERE role = 'user' AND nr = 'assistant'
)"""
ANSWERS = TURNS + """, answers AS (
  SELECT *, concat(CASE WHEN fmt = 3 THEN concat('| A | B |', chr(10), '| --- | --- |', chr(10)) ELSE '' END,
    array_to_string(list_transform(str_split(answer_raw, chr(10)), lambda x, i: concat(
      CASE fmt WHEN 1 THEN '- ' WHEN 2 THEN concat(i, '. ') WHEN 3 THEN '| ' ELSE '' END, x,
      CASE WHEN fmt = 3 THEN concat(' | [', 1 + (i * 7 + session_id) % (n_sources + 2), '] |')
           WHEN (i + turn_id) % 3 <> 0 THEN concat(' [', 1 + (i * 7 + session_id) % (n_sources + 2), ']') ELSE '' END)), chr(10))) AS answer
  FROM turns
)"""
MARKED = ANSWERS + """, marked AS (
  SELECT turn_id, array_to_string(list_transform(str_split(answer, chr(10)), lambda x, i: concat(
    CASE (turn_id + (i - 1) * 3) % 11 WHEN 1 THEN '```' || chr(10) WHEN 3 THEN ' ~~~ text' || chr(10) WHEN 4 THEN '```' || chr(10) WHEN 5 THEN '## ' WHEN 6 THEN repeat(chr(10), 3)
      WHEN 7 THEN '1. ' WHEN 8 THEN '**bold** `code` _it_ [site](http://x.example) ' ELSE '' END, x)), chr(10)) AS answer FROM answers
)"""
SOURCES = """sources AS (
  SELECT turn_id, k AS idx, concat('https://', CASE WHEN k % 3 = 0 THEN 'www.' ELSE '' END, 'site', (session_id + k) % 20, '.example.com/d/', session_id * 10 + k) AS url, concat('Title ', k) AS title
  FROM turns, unnest(generate_series(1, n_sources)) AS g(k)
)"""
RANKED = """ranked AS (
  SELECT turn_id, p AS position, concat('https://site', 1 + (p * 5 + turn_id) % (n_sources + 3), '.example.com/d/', session_id) AS source_url,
    CASE WHEN (p + turn_id) % 9 = 0 THEN '' ELSE substr(answer_raw, CAST(p * 20 AS INT), 60) END AS text,
    CAST(CASE WHEN p <= 2 THEN 0.9 WHEN p <= 6 THEN 0.5 ELSE 0.1 END AS DOUBLE) AS score
  FROM turns, unnest(generate_series(1, 16)) AS g(p)
)"""
REQUESTS = """requests AS (
  SELECT event_id, user_id, ts, concat(event_type, ' topic ', CAST(json_extract_string(props, '$.k') AS INT) % 7) AS query,
    event_type IN ('error', 'view') AS time_sensitive, value >= 5 AS cacheable FROM events
)"""
CALLS = """calls AS (
  SELECT CAST(floor(event_id / 4.0) AS BIGINT) AS turn_id,
    CASE event_id % 4 WHEN 0 THEN 'triage' WHEN 1 THEN 'synthesis' WHEN 2 THEN 'follow_ups' ELSE '' END AS stage,
    CASE event_id % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'large' ELSE 'unpriced' END AS model,
    CAST(floor(value * 10) AS BIGINT) AS prompt_tokens, CAST(floor(value * 3) AS BIGINT) AS completion_tokens, user_id, ts FROM events
), prices(model, prompt_usd, completion_usd) AS (VALUES ('small', CAST(0.05 AS DOUBLE), CAST(0.08 AS DOUBLE)), ('large', 0.59, 0.79)), priced AS (
  SELECT c.*, prompt_tokens + completion_tokens AS total_tokens, coalesce((prompt_tokens * prompt_usd + completion_tokens * completion_usd) / 1000000, 0) AS cost_usd
  FROM calls c LEFT JOIN prices USING (model)
)"""
QUESTIONS = """questions AS (
  SELECT item_id * 8 + v AS q_id, item_id, trim(CASE v WHEN 0 THEN s WHEN 1 THEN concat('best ', s) WHEN 2 THEN concat('worst ', s) WHEN 3 THEN concat(s, ' 3.11')
    WHEN 4 THEN concat(s, ' 3.12') WHEN 5 THEN concat('explain ', s) WHEN 6 THEN concat('alpha vs beta ', s) ELSE concat('beta vs alpha ', s) END) AS question
  FROM (SELECT item_id, lower(text) AS s FROM benchmark) b, (VALUES (0), (1), (2), (3), (4), (5), (6), (7)) g(v)
)"""
MARKERS = r"list_transform(regexp_extract_all(answer, '\[(\d+)\]', 1), lambda x: CAST(x AS INT))"
NUMBERED = """numbered AS (
  SELECT turn_id, CAST(dense_rank() OVER (PARTITION BY turn_id ORDER BY first) AS INT) AS idx, source_url AS url, position, text FROM (
    SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY position) AS n FROM (
      SELECT *, dense_rank() OVER (PARTITION BY turn_id ORDER BY first) AS src FROM (
        SELECT *, min(position) OVER (PARTITION BY turn_id, source_url) AS first FROM ranked WHERE source_url <> '' AND text <> ''
      ) a) b WHERE src <= 8) c WHERE n <= 12
)"""
# turns of the live log: what each comes to once all time has passed
LIVE = f"""{ANSWERS}, {SOURCES}, listed AS (
  SELECT turn_id, string_agg(url, ',' ORDER BY idx) AS urls, string_agg(url, ',' ORDER BY idx % 2 DESC, idx) AS odd_first, string_agg(url, ',' ORDER BY idx) FILTER (idx % 2 = 1) AS odd FROM sources GROUP BY turn_id
), live AS (
  SELECT turn_id, CASE WHEN turn_id % 17 = 6 THEN substr(answer, 1, 60) ELSE answer END AS answer, CASE WHEN turn_id % 17 = 6 THEN odd WHEN turn_id % 3 = 0 THEN urls ELSE odd_first END AS urls,
    CASE WHEN turn_id % 17 = 6 THEN '["first"]' ELSE concat('["last ', turn_id, '"]') END AS images, CASE WHEN turn_id % 17 <> 6 THEN concat('{{"turn":', turn_id, '}}') END AS trace,
    CASE WHEN turn_id % 17 = 6 THEN '' ELSE concat('more on ', turn_id, '|why') END AS follow_ups, CASE WHEN turn_id % 17 = 6 OR turn_id % 13 = 4 THEN 'timeout' END AS error
  FROM answers JOIN listed USING (turn_id) WHERE turn_id % 11 <> 5 OR turn_id % 17 = 6
)"""
