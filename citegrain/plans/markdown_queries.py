"""Queries over answers as Markdown."""

from __future__ import annotations

from .. import fixtures as X
from ..functions import markdown as M
from ..operators import markdown as B
from . import relations_sql as Q
from .catalog import query

_INLINE = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0},
  '\*\*\*(.+?)\*\*\*', '\1', 'g'), '\*\*(.+?)\*\*', '\1', 'g'), '\*(.+?)\*', '\1', 'g'), '__(.+?)__', '\1', 'g'), '_(.+?)_', '\1', 'g'), '`(.+?)`', '\1', 'g'), '\[(\d+)\]', '', 'g'), '\[([^\]]+)\]\([^)]*\)', '\1', 'g'), '!\[([^\]]*)\]\([^)]*\)', '', 'g'))"""


def _blocks(inside: str) -> str:
    """`inside`: the state behind a fence of kind k in a block of kind s."""
    return rf"""WITH RECURSIVE {Q.MARKED}, l AS (
  SELECT turn_id, i - 1 AS line_no, x[i] AS raw, CASE WHEN regexp_matches(x[i], '^\s*```') THEN 1 WHEN regexp_matches(x[i], '^\s*~~~') THEN 2 ELSE 0 END AS k
  FROM (SELECT turn_id, x, unnest(generate_series(1, len(x))) AS i FROM (SELECT turn_id, str_split(answer, chr(10)) AS x FROM marked WHERE answer <> ''))
), f AS (
  SELECT turn_id, line_no, k, row_number() OVER (PARTITION BY turn_id ORDER BY line_no) AS n FROM l WHERE k > 0
), s AS (
  SELECT turn_id, n, line_no, 0 AS before, k AS behind FROM f WHERE n = 1
  UNION ALL
  SELECT f.turn_id, f.n, f.line_no, s.behind, CASE WHEN s.behind = 0 THEN f.k ELSE {inside} END FROM s JOIN f ON f.turn_id = s.turn_id AND f.n = s.n + 1
), t AS (
  SELECT l.*, coalesce(s.behind, 0) AS state, rtrim(raw) AS line, trim(raw) AS shown FROM l ASOF LEFT JOIN s ON s.turn_id = l.turn_id AND s.line_no < l.line_no
), c AS (
  SELECT *, CASE WHEN state > 0 THEN 'code' WHEN shown = '' THEN 'blank' WHEN regexp_matches(line, '^#{{1,3}}\s') THEN concat('heading', len(regexp_extract(line, '^#+')))
    WHEN regexp_matches(line, '^\s*([-*+]|\d+\.)\s+') THEN 'bullet' WHEN shown LIKE '|%' THEN 'table-row' ELSE 'paragraph' END AS type
  FROM t WHERE (k = 0 OR (state > 0 AND {inside.replace('f.k', 'k').replace('s.behind', 'state')} = state)) AND (state > 0 OR NOT regexp_full_match(shown, '\|[\s:|-]+\|'))
)
SELECT turn_id, CAST(line_no AS INT) AS line_no, type, CASE WHEN type LIKE 'heading%' THEN CAST(right(type, 1) AS INT) END AS level,
  CASE WHEN type = 'code' THEN raw WHEN type = 'blank' THEN '' WHEN type LIKE 'heading%' THEN {_INLINE.format("regexp_replace(line, '^#+\\s+', '')")} WHEN type = 'bullet' THEN {_INLINE.format("regexp_replace(line, '^\\s*([-*+]|\\d+\\.)\\s+', '')")}
    WHEN type = 'table-row' THEN array_to_string(list_filter(list_transform(str_split(line, '|'), lambda x: trim(x)), lambda x: x <> ''), '  |  ') ELSE {_INLINE.format('line')} END AS text FROM c"""


query("markdown_blocks", _blocks("CASE WHEN s.behind = f.k THEN 0 ELSE s.behind END"))(lambda spark, d: B.markdown_blocks(X.marked(spark, d)))
query("markdown_blocks_any_fence", _blocks("0"))(lambda spark, d: B.markdown_blocks(X.marked(spark, d), any_closes=True))
query("answer_plain_text", rf"""WITH {Q.MARKED} SELECT turn_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(answer,
  '\[(\d+)\]', '', 'g'), '#{{1,6}}\s+', '', 'g'), '(?s)\*\*(.+?)\*\*', '\1', 'g'), '(?s)\*(.+?)\*', '\1', 'g'), '(?s)```.*?```', '', 'g'), '`(.+?)`', '\1', 'g'),
  '(?m)^\s*[-*+]\s+', '', 'g'), '(?m)^\s*\d+\.\s+', '', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS plain FROM marked""")(
    lambda spark, d: X.marked(spark, d).select("turn_id", M.plain_text(X.F.col("answer")).alias("plain"))
)
