"""Answer structure and run scoring: lines, claims, formats, summaries, baselines."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.answers import MIN_CLAIM, with_structure
from .citations import with_audit

# How far each metric may fall below the baseline.
TOLERANCE = {"mean_coverage": 0.10, "mean_utilization": 0.10, "format_compliance_rate": 0.15, "triage_format_match_rate": 0.15}
FORMATS = ("table", "list", "steps", "prose")


def markdown_lines(answers: DataFrame, key: str = "turn_id") -> DataFrame:
    """(key, i, line, kind) of each line outside code fences; an open fence hides the rest."""
    rows = answers.select(key, F.posexplode(T.lines(F.col("answer"))).alias("i", "line"))
    order = Window.partitionBy(key).orderBy("i")
    fence = F.col("line").rlike(T.FENCE)
    seen = rows.withColumn("fences", F.sum(fence.cast("int")).over(order)).where(~fence & (F.col("fences") % 2 == 0))
    return seen.select(key, "i", "line", T.line_class(F.col("line")).alias("kind"))


def claim_units(lines: DataFrame, key: str = "turn_id") -> DataFrame:
    """(key, i, unit): sentences and list items of 45 characters or more, and table data rows."""
    order = Window.partitionBy(key).orderBy("i")
    stops = F.sum(F.col("kind").isin("blank", "heading", "row", "item").cast("int")).over(order)
    block = F.sum((F.col("kind") == "blank").cast("int")).over(order)
    placed = lines.withColumn("island", stops).withColumn("block", block)
    placed = placed.withColumn("data", F.max((F.col("kind") == "separator").cast("int")).over(Window.partitionBy(key, "block").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)))
    stripped = F.trim("line")
    prose = placed.where("kind = 'prose'").groupBy(key, "island").agg(F.min("i").alias("i"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", stripped.alias("s")))), lambda x: x["s"]), " ").alias("p"))
    sentences = prose.select(key, "i", F.explode(T.split_sentences(F.col("p"))).alias("unit")).withColumn("unit", F.trim("unit")).where(F.length("unit") >= MIN_CLAIM)
    items = placed.where("kind = 'item'").select(key, "i", F.regexp_replace(stripped, r"^\s*(?:[-*+]|\d+[.)])\s+", "").alias("unit")).where(F.length("unit") >= MIN_CLAIM)
    cells = F.split(F.regexp_replace(stripped, r"^\|+|\|+$", ""), r"\|")
    rows = placed.where((F.col("kind") == "row") & (F.col("data") == 1) & F.exists(cells, lambda c: F.length(F.trim(c)) >= 2)).select(key, "i", stripped.alias("unit"))
    return sentences.unionByName(items).unionByName(rows)


def citation_coverage(units: DataFrame, key: str = "turn_id") -> DataFrame:
    """(key, cited_units, total_units) of answers that have units."""
    return units.groupBy(key).agg(F.count(F.when(F.col("unit").rlike(T.MARKER), 1)).alias("cited_units"), F.count(F.lit(1)).alias("total_units"))


def structure(lines: DataFrame, key: str = "turn_id") -> DataFrame:
    """(key, list_items, ordered_items, table_columns, has_table): table_columns is the first table's."""
    after = lines.withColumn("next", F.lead("kind").over(Window.partitionBy(key).orderBy("i")))
    is_row, item = F.col("line").rlike(T.ROW), F.col("line").rlike(T.BULLET) | F.col("line").rlike(T.ORDERED)
    columns = F.when(is_row & (F.col("next") == "separator"), F.size(F.split(F.regexp_replace(F.trim("line"), r"^\|+|\|+$", ""), r"\|")))
    return after.withColumn("columns", columns).groupBy(key).agg(
        F.count(F.when(item & ~is_row, 1)).alias("list_items"), F.count(F.when(F.col("line").rlike(T.ORDERED) & ~is_row, 1)).alias("ordered_items"),
        F.coalesce(F.min_by("columns", F.when(F.col("columns").isNotNull(), F.col("i"))), F.lit(0)).cast("long").alias("table_columns"), F.coalesce(F.max(F.col("columns") >= 2), F.lit(False)).alias("has_table"),
    )


def format_ok(declared: Column, mode: Column) -> Column:
    """Whether an answer's structure is the one declared; needs the columns of `structure`."""
    kind = F.lower(F.trim(T.text(declared)))
    kept = F.when(kind == "table", F.coalesce("has_table", F.lit(False))).when(kind == "steps", F.coalesce("ordered_items", F.lit(0)) >= 2).when(kind == "list", F.coalesce("list_items", F.lit(0)) >= 2).otherwise(True)
    return (mode == "chat") | kept


def is_fallback(answer: Column) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(T.text(answer), F.lit(m)) for m in T.FALLBACKS))


def missing_terms(answer: Column, terms: Column) -> Column:
    return F.filter(F.coalesce(terms, F.array().cast("array<string>")), lambda t: ~F.contains(F.lower(T.text(answer)), F.lower(t)))


def score_runs(runs: DataFrame) -> DataFrame:
    """One row of measures for each run (turn_id, query, answer, n_sources, mode, declared, expected, must_mention,
    ranked_chunks, top_score, latency_ms, total_tokens, cost_usd, error). A failed run keeps only its identity and error."""
    audited = with_audit(with_structure(runs.where("coalesce(error, '') = ''")))
    declared, expected = T.text(F.col("declared")), T.text(F.col("expected"))
    match = F.when(F.col("mode") == "chat", expected.isin("", "chat", "prose")).otherwise((expected == "") | (declared == expected))
    scored = audited.select(
        "turn_id", "query", "error", (F.trim(T.text(F.col("answer"))) != "").alias("answered"), is_fallback(F.col("answer")).alias("fallback"), "mode", "declared", "expected",
        "cited_units", "total_units", F.when(F.col("total_units") > 0, F.round(F.col("cited_units") / F.col("total_units"), 6)).otherwise(0.0).alias("coverage"),
        F.col("n_valid_distinct").alias("sources_used"), F.col("n_sources").alias("sources_provided"), "utilization", "invalid", "ranked_chunks", "top_score",
        format_ok(F.col("declared"), F.col("mode")).alias("format_ok"), match.alias("triage_format_match"), missing_terms(F.col("answer"), F.col("must_mention")).alias("missing_terms"), "latency_ms", "total_tokens", "cost_usd",
    )
    failed = runs.where("coalesce(error, '') <> ''").select("turn_id", "query", "error")
    return scored.unionByName(failed, allowMissingColumns=True)


def failures(allow_fallback: Column) -> Column:
    """What fails a run outright, in a fixed order; a run's error is then all there is."""
    found = F.array_compact(F.array(
        F.when(~F.col("answered"), "empty answer"),
        F.when(F.size("invalid") > 0, F.concat(F.lit("fabricated citation markers: ["), F.array_join(F.col("invalid").cast("array<string>"), ", "), F.lit("]"))),
        F.when(F.col("fallback") & ~F.coalesce(allow_fallback, F.lit(False)), "returned a fallback message instead of an answer"),
        F.when((F.col("mode") == "research") & ~F.col("fallback") & (F.col("sources_provided") == 0), "research answer with no sources"),
        F.when(F.size("missing_terms") > 0, F.concat(F.lit("missing required terms: "), F.array_join("missing_terms", ", "))),
    ))
    return F.when(T.text(F.col("error")) != "", F.array(F.concat(F.lit("run failed: "), F.col("error")))).otherwise(found)


def hard_failures(scores: DataFrame, specs: DataFrame) -> DataFrame:
    """(turn_id, problems) of runs with any; `specs` has (turn_id, allow_fallback)."""
    return scores.join(specs, "turn_id", "left").select("turn_id", failures(F.col("allow_fallback")).alias("problems")).where(F.size("problems") > 0)


def summarize(scores: DataFrame) -> DataFrame:
    """One row: quality over research runs, triage and latency over runs without error, totals over all."""
    ok = T.text(F.col("error")) == ""
    research = ok & (F.col("mode") == "research") & ~F.col("fallback")
    mean = lambda c, when: F.round(F.coalesce(F.avg(F.when(when, c.cast("double"))), F.lit(0.0)), 4)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return scores.agg(
        F.count(F.lit(1)).alias("queries"), F.count(F.when(~ok, 1)).alias("errors"), total(F.when(ok, F.size("invalid"))).alias("total_invalid_citations"),
        mean(F.col("coverage"), research).alias("mean_coverage"), mean(F.col("utilization"), research).alias("mean_utilization"),
        mean(F.col("format_ok").cast("int"), research).alias("format_compliance_rate"), mean(F.col("triage_format_match").cast("int"), ok).alias("triage_format_match_rate"),
        mean(F.col("sources_provided"), research).alias("mean_sources"), mean(F.col("ranked_chunks"), research).alias("mean_ranked_chunks"), mean(F.col("top_score"), research).alias("mean_top_rerank_score"),
        F.floor(mean(F.col("latency_ms"), ok)).alias("mean_latency_ms"), F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("total_cost_usd"), total(F.col("total_tokens")).alias("total_tokens"),
    )


def compare_to_baseline(summary: DataFrame, baseline: DataFrame) -> DataFrame:
    """(metric, before, after, tolerance) of metrics that fell below the baseline by more than their tolerance."""

    def long(df: DataFrame, name: str) -> DataFrame:
        there = [m for m in TOLERANCE if m in df.columns]
        pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in there])
        return df.select(F.inline(pairs)).where(F.col(name).isNotNull())

    tolerance = F.create_map(*[F.lit(x) for pair in TOLERANCE.items() for x in pair])[F.col("metric")]
    both = long(summary, "after").join(long(baseline, "before"), "metric").withColumn("tolerance", tolerance)
    return both.where(F.col("after") < F.col("before") - F.col("tolerance")).select("metric", "before", "after", "tolerance")


def load_specs(specs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, problems): `problems` has (id, problem) for ids that repeat, missing fields, unknown formats and, where there is a
    column history (JSON: an array of turns that each have a query), malformed histories."""
    n = F.count(F.lit(1)).over(Window.partitionBy("id"))
    malformed = []
    if "history" in specs.columns:
        told = F.trim(T.text(F.col("history")))
        turns = F.from_json(told, "array<string>")
        # a key that is there may hold null; only objects have keys
        named = F.exists(turns, lambda t: ~F.array_contains(F.coalesce(F.json_object_keys(t), F.array().cast("array<string>")), "query"))
        malformed = [F.when(~told.isin("", "null", "[]", "{}") & (~told.startswith("[") | turns.isNull() | F.coalesce(named, F.lit(True))), "malformed history")]
    bad = F.array_compact(F.array(
        F.when(T.text(F.col("id")) == "", "missing id"), F.when((T.text(F.col("id")) != "") & (n > 1), "duplicate id"), F.when(F.trim(T.text(F.col("query"))) == "", "missing query"),
        F.when((T.text(F.col("expected_format")) != "") & ~F.col("expected_format").isin(*FORMATS, "chat"), "unknown format"), *malformed,
    ))
    judged = specs.withColumn("_bad", bad)
    return judged.where(F.size("_bad") == 0).drop("_bad"), judged.select("id", F.explode("_bad").alias("problem"))


def render_report(summary: DataFrame) -> DataFrame:
    """(report): the summary as a Markdown table."""
    names = summary.columns
    rows = F.concat_ws("\n", F.lit("| Metric | Value |"), F.lit("|---|---|"), *[F.concat(F.lit(f"| {c} | "), F.col(c).cast("string"), F.lit(" |")) for c in names])
    return summary.select(rows.alias("report"))


def _percent(c: Column, digits: int = 0) -> Column:
    return F.concat(F.format_string(f"%.{digits}f", F.bround(c * 100, digits)), F.lit("%"))


def regression_lines(regressions: DataFrame) -> DataFrame:
    """(metric, line) of the rows of `compare_to_baseline`."""
    told = F.concat("metric", F.lit(": "), _percent(F.col("after"), 2), F.lit(" vs baseline "), _percent(F.col("before"), 2), F.lit(" (tolerance "), _percent(F.col("tolerance")), F.lit(")"))
    return regressions.select("metric", told.alias("line"))


def report_lines(summary: DataFrame, scores: DataFrame, regressions: DataFrame, failed: DataFrame, generated_at: str) -> DataFrame:
    """(section, place, id, line): the whole report as ordered lines, as many as it has runs: head and metrics (section 1),
    regressions (2), hard failures (3) and a row for each run (4). Sections 2 and 3 are there if they have lines. `failed`
    has (turn_id, problems)."""
    wrong = regressions.select(F.lit(1).alias("x")).limit(1).unionAll(failed.select(F.lit(1).alias("x")).limit(1)).agg(F.count("x").alias("wrong"))
    # fixed values: the report's metrics and forms
    metric = lambda name, shown: F.concat(F.lit(f"| {name} | "), shown, F.lit(" |"))
    c = F.col
    head = F.array(
        F.concat(F.lit("# Eval run — "), F.when(c("wrong") == 0, "PASS").otherwise("FAIL")), F.lit(""),
        F.format_string("_%s · %d queries · $%.4f · %.1fs mean_", F.lit(generated_at), c("queries"), c("total_cost_usd"), c("mean_latency_ms") / 1000), F.lit(""), F.lit("| Metric | Value |"), F.lit("| --- | --- |"),
        metric("Fabricated citations", F.concat(F.lit("**"), c("total_invalid_citations").cast("string"), F.lit("**"))), metric("Citation coverage", _percent(c("mean_coverage"))), metric("Source utilization", _percent(c("mean_utilization"))),
        metric("Format compliance", _percent(c("format_compliance_rate"))), metric("Triage format match", _percent(c("triage_format_match_rate"))), metric("Mean sources", F.format_string("%.1f", F.bround("mean_sources", 1))),
        metric("Mean top rerank score", F.format_string("%.3f", F.bround("mean_top_rerank_score", 3))), metric("Errored runs", c("errors").cast("string")), F.lit(""),
    )
    none = F.lit(None).cast("string")
    first = summary.crossJoin(F.broadcast(wrong)).select(F.lit(1).alias("section"), F.posexplode(head).alias("place", "line")).withColumn("id", none)  # one row each

    def listed(rows: DataFrame, section: int, title: tuple[str, ...], key: str, line: Column) -> DataFrame:
        """A section of `rows`, with its title where it has any."""
        body = rows.select(F.lit(section).alias("section"), F.lit(len(title)).alias("place"), c(key).cast("string").alias("id"), line.alias("line"))
        titles = F.posexplode(F.array(*map(F.lit, title)))
        return rows.limit(1).select(F.lit(section).alias("section"), titles.alias("place", "line")).withColumn("id", none).unionByName(body)

    problems = F.concat(F.lit("- **"), c("turn_id").cast("string"), F.lit("** — "), F.array_join("problems", "; "))
    dash = lambda x: F.coalesce(F.nullif(x, F.lit("")), F.lit("—"))
    fmt = F.concat(dash(c("declared")), F.when(F.coalesce("format_ok", F.lit(True)), "").otherwise(" ⚠"))
    zero = lambda name: F.coalesce(name, F.lit(0.0))
    n_invalid = F.greatest(F.coalesce(F.size("invalid"), F.lit(0)), F.lit(0))
    cells = [
        c("turn_id").cast("string"), dash(c("mode")), fmt, _percent(zero("coverage")), _percent(zero("utilization")), F.when(n_invalid > 0, n_invalid.cast("string")).otherwise(""),
        F.format_string("%.1fs", F.bround(zero("latency_ms") / 1000, 1)), F.format_string("$%.5f", zero("cost_usd")),
    ]
    row = F.concat(F.lit("| "), *[x for cell in cells[:-1] for x in (cell, F.lit(" | "))], cells[-1], F.lit(" |"))
    told = ("## Per query", "", "| Query | Mode | Format | Cov | Util | Cites | Latency | Cost |", "| --- | --- | --- | --- | --- | --- | --- | --- |")
    parts = [listed(regression_lines(regressions), 2, ("## Regressions", ""), "metric", F.concat(F.lit("- "), "line")), listed(failed, 3, ("## Hard failures", ""), "turn_id", problems), listed(scores, 4, told, "turn_id", row)]
    return reduce(DataFrame.unionByName, parts, first).select("section", "place", "id", "line")


def update_baseline(summary: DataFrame, path: str) -> str:
    """Make a summary (one row) the baseline in `path`, and return its version, a digest of its values. The version is
    written whole beside the others before the pointer to it is switched in one step, so that a run that fails leaves
    the old baseline and a repeated one changes nothing."""
    spark = summary.sparkSession
    version = summary.select(F.sha2(F.to_json(F.struct(*sorted(summary.columns)), {"ignoreNullFields": "false"}), 256)).first()[0]
    if _pointed(spark, path) != version:
        summary.coalesce(1).write.mode("overwrite").parquet(f"{path}/versions/{version}")
        jvm = spark._jvm
        made, pointer = (jvm.org.apache.hadoop.fs.Path(f"{path}/{name}") for name in (f"pointer-{uuid.uuid4().hex}", "current"))
        conf = spark._jsc.hadoopConfiguration()
        out = made.getFileSystem(conf).create(made)
        out.writeBytes(version)
        out.close()
        how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri(), conf).rename(made, pointer, how)
    return version


def _pointed(spark: SparkSession, path: str) -> str | None:
    pointer = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/current")
    if not pointer.getFileSystem(spark._jsc.hadoopConfiguration()).exists(pointer):
        return None
    return spark.read.text(f"{path}/current").first()[0]


def read_baseline(spark: SparkSession, path: str) -> DataFrame | None:
    """The baseline that `path` points to, or None before the first."""
    version = _pointed(spark, path)
    return spark.read.parquet(f"{path}/versions/{version}") if version else None


def write_eval(scores: DataFrame, summary: DataFrame, path: str) -> None:
    scores.write.mode("overwrite").parquet(f"{path}/scores")
    summary.write.mode("overwrite").json(f"{path}/summary")
