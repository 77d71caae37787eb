"""Embedding of questions and scoring of passages in batches, by models that the user brings."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions import text as T
from .reuse import normalize_vector

Predict = Callable[..., np.ndarray]  #: one or more columns of texts to a matrix of one row each


def forgiving(make_model: Callable[[], Predict], pairs: bool = False) -> Callable[[], Predict]:
    """A model of texts, or of pairs of texts, whose failures are rows of NaN: a batch that fails is tried row by row."""

    def make() -> Predict:
        try:
            model = make_model()
        except Exception:  # noqa: BLE001 - a model that can't be loaded tells nothing
            model = None

        def one(i: int, columns: tuple) -> np.ndarray | None:
            try:
                return np.asarray(model(*(np.array([c[i]], object) for c in columns)), float).reshape(-1)
            except Exception:  # noqa: BLE001
                return None

        def predict(*columns: np.ndarray) -> np.ndarray:
            try:
                made = np.asarray(model(*columns), float)
                if made.ndim == 2 and len(made) == len(columns[0]) and made.shape[1]:
                    return made
            except Exception:  # noqa: BLE001
                pass
            rows = [one(i, columns) for i in range(len(columns[0]))]
            width = max((len(r) for r in rows if r is not None), default=1) or 1
            return np.array([r if r is not None and len(r) == width else np.full(width, np.nan) for r in rows])

        # Spark counts the parameters of what it is given
        return (lambda first, second: predict(first, second)) if pairs else (lambda texts: predict(texts))

    return make


def embed_questions(questions: DataFrame, make_model: Callable[[], Predict], id_col: str = "q_id", text_col: str = "question", batch_size: int = 64) -> DataFrame:
    """(id, e): the unit vector of each question, null where it is blank or the model fails. White space is collapsed, and equal
    texts are embedded once, whoever asked them; `make_model` loads the model in each Python worker."""
    cleaned = questions.select(id_col, F.trim(F.regexp_replace(T.text(F.col(text_col)), r"(?U)\s+", " ")).alias("_text"))
    embed = predict_batch_udf(forgiving(make_model), return_type=ArrayType(DoubleType()), batch_size=batch_size)
    made = cleaned.where("_text <> ''").select("_text").distinct().withColumn("_e", embed("_text"))
    whole = made.select("_text", F.when(~F.exists("_e", lambda x: x.isNull() | F.isnan(x)), normalize_vector(F.col("_e"))).alias("e"))
    return cleaned.join(whole, "_text", "left").select(id_col, "e")


def score_pairs(pairs: DataFrame, make_model: Callable[[], Predict], batch_size: int = 64) -> DataFrame:
    """(query_id, chunk_id, score) of pairs (query_id, chunk_id, query, text), as `rerank` takes them: the model tells one number for
    each query and text, and a pair that it fails on has null. Equal pairs of texts are scored once."""
    texts = [T.text(F.col(c)).alias(f"_{c}") for c in ("query", "text")]
    score = predict_batch_udf(forgiving(make_model, pairs=True), return_type=ArrayType(DoubleType()), batch_size=batch_size)
    rows = pairs.select("query_id", "chunk_id", *texts)
    scored = rows.select("_query", "_text").distinct().withColumn("_s", F.get(score("_query", "_text"), F.lit(0)))
    told = scored.select("_query", "_text", F.when(~F.isnan("_s"), F.col("_s")).alias("score"))
    return rows.join(told, ["_query", "_text"], "left").select("query_id", "chunk_id", "score")
