"""Conversations: lists, histories, exports and ownership."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import text as T


def latest_turns(turns: DataFrame, most: int = DEFAULTS.latest_turns) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy(F.col("minute_no").desc(), F.col("turn_id").desc())
    return turns.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def list_threads(turns: DataFrame, most_turns: int = DEFAULTS.latest_turns, most: int | None = None) -> DataFrame:
    """(user_id, session_id, title, turn_count, created, updated): threads of each user's latest turns, newest first."""
    place = F.struct("minute_no", "turn_id")
    threads = latest_turns(turns, most_turns).groupBy("user_id", "session_id").agg(F.min_by("query", place).alias("title"), F.count(F.lit(1)).alias("turn_count"), F.min("minute_no").alias("created"), F.max("minute_no").alias("updated"))
    if most is None:
        return threads
    order = Window.partitionBy("user_id").orderBy(F.col("updated").desc(), "session_id")
    return threads.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def thread_documents(turns: DataFrame) -> DataFrame:
    """(session_id, title, created, turns): each thread with its turns in order."""
    turn = F.struct("minute_no", "turn_id", "query", F.col("answer_raw").alias("answer"))
    threads = turns.groupBy("session_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return threads.select("session_id", F.col("turns")[0]["query"].alias("title"), F.col("turns")[0]["minute_no"].alias("created"), "turns")


def history_text(turns: DataFrame, most: int = DEFAULTS.history_turns, chars: int = 600) -> DataFrame:
    """(turn_id, history): the turns before, as User and Assistant lines with long answers cut."""
    answer = F.trim(T.text(F.col("answer_raw")))
    cut = F.when(F.length(answer) > chars, F.concat(F.rtrim(F.substring(answer, 1, chars)), F.lit("…"))).otherwise(answer)
    question = F.trim(T.text(F.col("query")))
    said = F.array_join(F.array_compact(F.array(F.when(question != "", F.concat(F.lit("User: "), question)), F.when(cut != "", F.concat(F.lit("Assistant: "), cut)))), "\n")
    before = Window.partitionBy("session_id").orderBy("turn").rowsBetween(-most, -1)
    return turns.withColumn("_said", said).select("turn_id", F.array_join(F.filter(F.collect_list("_said").over(before), lambda x: x != ""), "\n").alias("history"))


def recent_searches(turns: DataFrame, most: int = 10) -> DataFrame:
    """(user_id, n, query): the latest distinct questions, whatever their case."""
    newest = (F.col("minute_no").desc(), F.col("turn_id").desc())
    once = turns.withColumn("_k", F.row_number().over(Window.partitionBy("user_id", F.lower("query")).orderBy(*newest))).where("_k = 1")
    return once.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy(*newest))).where(F.col("n") <= most).select("user_id", "n", "query")


def with_user_name(turns: DataFrame, users: DataFrame) -> DataFrame:
    return turns.join(users.select("user_id", "preferred_name"), "user_id", "left").withColumn("preferred_name", T.text(F.col("preferred_name")))


def owned_by(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows whose owner asked for them; rows without an owner are nobody's."""
    return rows.join(asked, ["session_id", "user_id"], "left_semi")


def purge_threads(turns: DataFrame, sessions: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, sessions) without the threads that their owners asked to delete."""
    gone = owned_by(sessions, asked).select("session_id").distinct()
    return turns.join(gone, "session_id", "left_anti"), sessions.join(gone, "session_id", "left_anti")


def list_notes(notes: DataFrame) -> DataFrame:
    return notes.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("updated").desc(), "note_id")))


def export_threads_md(turns: DataFrame, sources: DataFrame) -> DataFrame:
    """(session_id, name, markdown): each thread as one document."""
    listed = sources.groupBy("turn_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "title", "url"))), lambda s: F.concat(s["idx"].cast("string"), F.lit(". ["), s["title"], F.lit("]("), s["url"], F.lit(")"))), "\n").alias("listed"))
    body = F.concat(T.text(F.col("answer_raw")), F.when(F.col("listed").isNotNull(), F.concat(F.lit("\n\n**Sources**\n"), F.col("listed"))).otherwise(""))
    rows = turns.join(listed, "turn_id", "left").withColumn("n", F.row_number().over(Window.partitionBy("session_id").orderBy("turn"))).withColumn("part", F.concat(F.lit("## Q"), F.col("n"), F.lit(": "), F.col("query"), F.lit("\n\n"), body))
    threads = rows.groupBy("session_id").agg(F.min_by("query", "turn").alias("title"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "part"))), lambda x: x["part"]), "\n\n").alias("parts"))
    return threads.select("session_id", F.concat(T.slug(F.col("title")), F.lit(".md")).alias("name"), F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), F.col("parts")).alias("markdown"))
