"""Filter interaction audit: what each filter removes in every order of the filters.

Five filters judge a text: A short, B repetitive, C capitals, D symbols, E copy of a smaller doc_id's text.
A to D come from one pass over the texts. E is an existential self-join: a left-semi join on hash, exact
text and smaller doc_id, in which only texts whose hash stands under several ids take part. Its ids are
united with those of the other failures, and each row's bits are gathered into one combination; the
counts by part and combination, a few rows, then play every order.

A group of copies may hold a third of all rows: the self-join's right side holds each text once, with its
smallest id, and large groups are dealt by salts.

A null text counts as empty, so null and empty texts are copies of each other. A null doc_id is smaller
than none and never a copy. Rows that repeat a doc_id are judged row by row; equal id and text make no
row a copy. Several label rows of one id count as one that has each label any of them has. Without
documents there are no parts and no rows.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

FILTERS = "ABCDE"
BIT = {name: 1 << i for i, name in enumerate(FILTERS)}
#: Hashes under several ids that are broadcast at most, at 16 bytes each.
BROADCAST_HASHES = 1_000_000
#: Rows of one group of copies that go to one task, about.
GROUP_ROWS = 2048
SALTS = 64


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def text_bits(text: Column, words: Column) -> Column:
    """The bits of A to D."""
    n, different = F.size(words), F.size(F.array_distinct(words))
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = {"A": n < 100, "B": different * 100 < n * 80, "C": capitals * 100 > F.length(text) * 10, "D": text.rlike("[#$%&*|]")}
    bits = F.lit(0)
    for name, failed in fails.items():
        bits = bits + F.when(failed, BIT[name]).otherwise(0)
    return bits


def copies(documents: DataFrame, shared: DataFrame) -> DataFrame:
    """The rows (id, hash, part, text) of `documents` whose text also stands under a smaller id. `shared` has the hashes
    under several ids, with their numbers of rows."""
    if shared.count() <= BROADCAST_HASHES:
        able = documents.join(F.broadcast(shared), "hash")
    else:
        deal = F.pmod(F.xxhash64("id", "part"), F.lit(SALTS)).cast("int")
        spread = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        able = documents.withColumn("salt", deal).join(spread, ["hash", "salt"]).drop("salt")
    tasks = F.ceil(F.col("n") / GROUP_ROWS).cast("int")
    left = able.withColumn("salt", F.pmod(F.xxhash64("id"), tasks).cast("int")).alias("l")
    first = able.groupBy("hash", "text").agg(F.min("id").alias("least"), F.max(tasks).alias("tasks"))
    right = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).alias("r")
    same = (F.col("l.hash") == F.col("r.hash")) & (F.col("l.salt") == F.col("r.salt")) & (F.col("l.text") == F.col("r.text"))
    return left.join(right, same & (F.col("r.least") < F.col("l.id")), "left_semi").select("id", "hash", "part")


def failures(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, hash, part, bits, n): the n rows of an id, text and part, and the filters that they fail, as bits."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = documents.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("text"))
    judged = plain.withColumn("words", words_of(F.col("text"))).select("id", "hash", "part", text_bits(F.col("text"), F.col("words")).alias("bits"))
    judged = materialize(judged.groupBy("id", "hash", "part", "bits").agg(F.count(F.lit(1)).alias("n")), "judged")
    shared = judged.groupBy("hash").agg(F.sum("n").alias("n"), F.min("id").alias("least"), F.max("id").alias("greatest"))
    shared = materialize(shared.where("least < greatest").select("hash", "n"), "shared")
    marked = copies(plain, shared).select("id", "hash", "part", F.lit(BIT["E"]).alias("bits"), F.lit(0).cast("long").alias("n"))
    return judged.unionByName(marked).groupBy("id", "hash", "part").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))


def combinations(failed: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, bits, n, good, toxic): documents by part and combination of failures, and those with either label."""
    is_one = lambda name: F.coalesce(F.max((F.col(name) == 1).cast("int")), F.lit(0)).alias(name)
    known = labels.groupBy(F.col(id_col).alias("id")).agg(is_one("quality"), is_one("toxic"))
    with_label = lambda name: F.sum(F.when(F.col(name) == 1, F.col("n")).otherwise(0))
    return failed.join(known, "id", "left").groupBy("part", "bits").agg(F.sum("n").alias("n"), with_label("quality").alias("good"), with_label("toxic").alias("toxic"))


def steps() -> Column:
    """The steps of every order, one row each: filter_order, step, its filter's bit and those of the filters before."""
    told = [
        {"filter_order": "".join(order), "step": k + 1, "bit": BIT[name], "before": sum(BIT[x] for x in order[:k])}
        for order in permutations(FILTERS) for k, name in enumerate(order)
    ]
    return F.inline(F.from_json(F.lit(json.dumps(told)), "array<struct<filter_order:string,step:int,bit:int,before:int>>"))


def filter_audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), zeros included."""
    # the counts are few rows, and written so that the orders don't wait for one plan over the whole corpus
    counted = materialize(combinations(failures(documents), labels), "combinations")
    fails, before = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits").bitwiseAND(F.col("before")) != 0
    total = lambda condition, of="n": F.sum(F.when(condition, F.col(of)).otherwise(0)).cast("long")
    # of the orders of k failing filters, one in k puts this one first
    orders = F.lit(factorial(len(FILTERS))) / F.bit_count("bits")
    return counted.select("*", steps()).groupBy("part", "filter_order", "step").agg(
        total(~fails & ~before).alias("kept"), total(fails & ~before).alias("removed"), total(fails & before).alias("redundant"),
        total(F.col("bits") == F.col("bit")).alias("unique_fails"), total(fails & ~before, "good").alias("good_lost"), total(fails & ~before, "toxic").alias("toxic_lost"),
        F.sum(F.when(fails, F.col("n") * orders.cast("long")).otherwise(0)).cast("long").alias("shapley"),
    )
