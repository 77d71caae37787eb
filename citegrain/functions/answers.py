"""Structure and claims of an answer as column expressions over its own lines: no shuffle, no window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import markdown as M
from . import text as T

MIN_CLAIM = 45
# Lines are split at these characters among others, so that none stands inside a line.
_NEXT, _STOP = "\x1e", "\x1d"


def with_visible_lines(answers: DataFrame, answer: str = "answer", name: str = "visible") -> DataFrame:
    """`answers` with an array of (line, kind): the lines outside code fences; an open fence hides the rest."""
    lines = answers.withColumn("_lines", T.lines(F.col(answer))).withColumn("_fences", F.transform("_lines", lambda x: x.rlike(T.FENCE).cast("int")))
    states = lines.withColumn("_states", M.line_states(F.col("_fences"), any_closes=True))
    zipped = states.withColumn("_zipped", F.arrays_zip("_lines", "_fences", "_states"))
    shown = F.filter("_zipped", lambda x: (x["_fences"] == 0) & (x["_states"] == 0))
    told = F.transform(shown, lambda x: F.struct(x["_lines"].alias("line"), T.line_class(x["_lines"]).alias("kind")))
    return zipped.withColumn(name, told).drop("_lines", "_fences", "_states", "_zipped")


def _cells(line: Column) -> Column:
    return F.split(F.regexp_replace(F.trim(line), r"^\|+|\|+$", ""), r"\|")


def claims(visible: Column) -> Column:
    """Sentences and list items of 45 characters or more, and table rows below a divider of their block, in no order."""
    prose = F.array_join(F.transform(visible, lambda v: F.when(v["kind"] == "prose", F.trim(v["line"])).when(v["kind"] != "separator", _STOP)), _NEXT)
    islands = F.filter(F.split(prose, f"{_NEXT}?{_STOP}{_NEXT}?"), lambda p: p != "")
    sentences = F.flatten(F.transform(islands, lambda p: F.transform(T.split_sentences(F.replace(p, F.lit(_NEXT), F.lit(" "))), lambda s: F.trim(s))))
    items = F.transform(F.filter(visible, lambda v: v["kind"] == "item"), lambda v: F.regexp_replace(F.trim(v["line"]), r"^\s*(?:[-*+]|\d+[.)])\s+", ""))
    # blocks of rows and dividers, parted by blank lines; what stands behind a block's first divider
    told = F.array_join(F.transform(visible, lambda v: F.when(v["kind"] == "blank", _STOP).when(v["kind"] == "separator", "s").when(v["kind"] == "row", F.concat(F.lit("r"), F.trim(v["line"])))), _NEXT)
    below = F.transform(F.split(told, _STOP), lambda b: F.regexp_extract(F.concat(F.lit(_NEXT), b), f"(?s){_NEXT}s(?:{_NEXT}(.*))?$", 1))
    rows = F.filter(F.flatten(F.transform(below, lambda b: F.split(b, _NEXT))), lambda r: r.startswith("r"))
    rows = F.filter(F.transform(rows, lambda r: F.substr(r, F.lit(2))), lambda r: F.exists(_cells(r), lambda c: F.length(F.trim(c)) >= 2))
    return F.concat(F.filter(F.concat(sentences, items), lambda u: F.length(u) >= MIN_CLAIM), rows)


def tables(visible: Column) -> Column:
    """The number of columns of each table: of the rows that a divider follows."""
    heads = F.filter(visible, lambda v, i: v["line"].rlike(T.ROW) & (F.get(visible, i + 1)["kind"] == "separator"))
    return F.transform(heads, lambda v: F.size(_cells(v["line"])))


def with_structure(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """`answers` with cited_units, total_units, list_items, ordered_items, table_columns (the first table's) and has_table."""
    shown = with_visible_lines(answers, answer, "_visible")
    made = shown.withColumn("_claims", claims(F.col("_visible"))).withColumn("_tables", tables(F.col("_visible")))
    size = lambda c: F.size(c).cast("long")
    ordered = lambda v: v["line"].rlike(T.ORDERED) & ~v["line"].rlike(T.ROW)
    bullet = lambda v: v["line"].rlike(T.BULLET) & ~v["line"].rlike(T.ROW)
    return made.withColumns({
        "cited_units": size(F.filter("_claims", lambda u: u.rlike(T.MARKER))), "total_units": size("_claims"),
        "list_items": size(F.filter("_visible", lambda v: bullet(v) | ordered(v))), "ordered_items": size(F.filter("_visible", ordered)),
        "table_columns": F.coalesce(F.get("_tables", F.lit(0)), F.lit(0)).cast("long"), "has_table": F.exists("_tables", lambda n: n >= 2),
    }).drop("_visible", "_claims", "_tables")
