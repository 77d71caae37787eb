"""Answers as Markdown blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markdown as M
from ..functions.text import text


def markdown_blocks(answers: DataFrame, id_col: str = "turn_id", text_col: str = "answer", any_closes: bool = False) -> DataFrame:
    """(id, line_no, type, level, text): heading1 to heading3, bullet, table-row, code, blank and paragraph. Fences and a
    table's dividers are markup and give no block; code keeps its lines as they are, and an unclosed block
    runs to the end. A fence of the other kind inside a block is code, unless `any_closes`. Null and empty texts have no blocks."""
    lines = answers.where(text(F.col(text_col)) != "").select(id_col, F.split(text_col, "\n").alias("lines")).withColumn("kinds", M.fence_kinds(F.col("lines")))
    rows = lines.withColumn("states", M.line_states(F.col("kinds"), any_closes)).select(id_col, F.posexplode(F.arrays_zip("lines", "kinds", "states")).alias("line_no", "x"))
    rows = rows.select(id_col, "line_no", F.col("x.lines").alias("raw"), F.col("x.kinds").alias("kind"), F.col("x.states").alias("state"))
    content = rows.where((F.col("kind") == 0) | ((F.col("state") > 0) & (F.col("state") != F.col("kind")) & F.lit(not any_closes)))
    line = F.regexp_replace("raw", rf"{M.SPACE}+$", "")
    shown = M.trim_space(line)
    row = shown.startswith("|")
    hashes = F.length(F.regexp_extract(line, M.HEADING, 1))
    kind = (
        F.when(F.col("state") > 0, "code").when(shown == "", "blank").when(hashes > 0, F.concat(F.lit("heading"), hashes.cast("string")))
        .when(line.rlike(M.BULLET) | line.rlike(M.NUMBERED), "bullet").when(row, F.when(~shown.rlike(M.DIVIDER), "table-row")).otherwise("paragraph")
    )
    told = content.select(id_col, "line_no", "raw", line.alias("line"), kind.alias("type"), hashes.alias("hashes")).where("type IS NOT NULL")
    of_line = F.col("line")
    shown_text = (
        F.when(F.col("type") == "code", F.col("raw")).when(F.col("type") == "blank", "").when(F.col("type").startswith("heading"), M.inline_text(F.regexp_extract(of_line, M.HEADING, 2)))
        .when(of_line.rlike(M.BULLET) & (F.col("type") == "bullet"), M.inline_text(F.regexp_extract(of_line, M.BULLET, 1))).when(F.col("type") == "bullet", M.inline_text(F.regexp_extract(of_line, M.NUMBERED, 1)))
        .when(F.col("type") == "table-row", F.array_join(F.filter(F.transform(F.split(of_line, r"\|"), M.trim_space), lambda c: c != ""), "  |  ")).otherwise(M.inline_text(of_line))
    )
    return told.select(id_col, "line_no", "type", F.when(F.col("type").startswith("heading"), F.col("hashes")).alias("level"), shown_text.alias("text"))
