"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased and everything but letters and their marks becomes one space; the n-grams of 1 to 4
code points, spaces among them, are hashed to a table of 2^BITS features with weights (1 + log tf) * idf,
scaled to length one. A follow-the-regularised-leader learner with an elastic net (L1 and L2) takes the
training rows one after another, then a temperature that makes rows it hasn't seen likeliest puts its
probabilities right.

Document frequencies are counted over all training rows, in one pass whose sums are as many as there are
features; the learner takes a bounded sample (`TRAIN_DOCS`, `TRAIN_CHARS`) by a hash of ids.

Null texts and texts without a letter are `und` with score 0, as all texts are if there are no training
rows. With a single language in training every other text is that one, with score 1. Very long texts are
read whole, a block at a time. Ties go to the smaller name. Repeated rows score alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEPT, slices
from .training import row_sample

#: Labelled rows and characters that the learner takes at most.
TRAIN_DOCS, TRAIN_CHARS = 4000, 16_000_000
ORDERS, BITS = (1, 2, 3, 4), 15
#: Code points handled at a time.
BLOCK = 1 << 20
UNDETERMINED = "und"


def letters_of(text: Column) -> Column:
    """Lower-cased words of letters between single spaces; null without letters."""
    return F.when(text.rlike(r"\p{L}"), F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " ")), F.lit(" ")))


def gram_counts(letters: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, counts) of a text's n-grams."""
    total = None
    for start in range(0, len(letters), BLOCK):
        # a block's n-grams start inside it and may end behind it
        codes = np.frombuffer(letters[start : start + BLOCK + max(ORDERS) - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        starts, scaled, found = min(BLOCK, len(letters) - start), codes * np.uint32(0x9E3779B1), []
        h = scaled
        for k in range(max(ORDERS)):
            if k:
                h = h[:-1] * np.uint32(0x01000193) + scaled[k:]
            if k + 1 in ORDERS:
                found.append((h[:starts] * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS))
        counts = np.bincount(np.concatenate(found), minlength=1 << BITS)
        total = counts if total is None else total + counts
    if total is None:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    features = np.flatnonzero(total)
    return features, total[features]


def weighted(letters: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, values) of a text, of length one."""
    features, counts = gram_counts(letters)
    values = (1 + np.log(counts)) * idf[features]
    norm = np.sqrt((values**2).sum())
    return features, (values / norm if norm > 0 else values).astype(np.float32)


@dataclass
class LanguageModel:
    names: list[str]
    idf: np.ndarray
    features: np.ndarray  #: those with a weight in any language
    weights: np.ndarray  #: by such feature and language
    bias: np.ndarray
    temperature: float

    def scorer(self) -> "Scorer":
        return Scorer(self)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Scorer:
    def __init__(self, model: LanguageModel):
        self.model = model
        self.weights = np.zeros((1 << BITS, len(model.names)), np.float32)
        self.weights[model.features] = model.weights

    def __call__(self, letters: str | None) -> tuple[str, float]:
        if letters is None or not self.model.names:
            return UNDETERMINED, 0.0
        features, values = weighted(letters, self.model.idf)
        p = softmax((values @ self.weights[features] + self.model.bias) / self.model.temperature)
        best = int(p.argmax())
        return self.model.names[best], float(p[best])


class Leader:
    """Follow-the-regularised-leader with per-coordinate rates; the last feature is the bias, which isn't penalised."""

    def __init__(self, n_classes: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.05, l2: float = 0.01):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(((1 << BITS) + 1, n_classes)), np.zeros(((1 << BITS) + 1, n_classes))

    def weights(self, rows=slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        return -np.sign(z) * np.maximum(np.abs(z) - self.l1, 0) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def bias(self) -> np.ndarray:
        return -self.z[-1] / ((self.beta + np.sqrt(self.n[-1])) / self.alpha)

    def learn(self, features: np.ndarray, values: np.ndarray, label: int) -> None:
        w, bias = self.weights(features), self.bias()
        error = softmax(values @ w + bias)
        error[label] -= 1
        for rows, g, old in ((features, values[:, None] * error, w), ([-1], error[None], bias[None])):
            n = self.n[rows]
            self.z[rows] += g - (np.sqrt(n + g**2) - np.sqrt(n)) / self.alpha * old
            self.n[rows] = n + g**2


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature from 1/16 to 16 at which the labels are likeliest, found by golden sections of its logarithm."""
    told = lambda t: -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(labels)), labels], 1e-300)).mean()
    low, high, ratio = -np.log(16), np.log(16), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if told(a) <= told(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(letters: list[str], langs: list[str], idf: np.ndarray, rounds: int = 3, held_every: int = 5) -> LanguageModel:
    """Learn from texts of letters, in their order; every fifth one settles the temperature alone."""
    names = sorted(set(langs))
    place = {name: i for i, name in enumerate(names)}
    rows = [(*weighted(text, idf), place[lang]) for text, lang in zip(letters, langs)]
    held = [r for i, r in enumerate(rows) if i % held_every == held_every - 1]
    leader = Leader(len(names))
    for _ in range(rounds if len(names) > 1 else 0):
        for i, row in enumerate(rows):
            if i % held_every != held_every - 1:
                leader.learn(*row)
    weights, bias = leader.weights()[:-1], leader.bias()
    logits = np.array([values @ weights[features] + bias for features, values, _ in held]).reshape(len(held), len(names))
    heat = temperature(logits, np.array([label for *_, label in held])) if len(held) > 0 and len(names) > 1 else 1.0
    features = np.flatnonzero(np.abs(weights).sum(axis=1))
    return LanguageModel(names, idf, features.astype(np.int32), weights[features].astype(np.float32), bias, heat)


def inverse_frequencies(letters: DataFrame) -> np.ndarray:
    """idf of each feature over all texts of the column `letters`: one row of sums for each feature and task, added by feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((1 << BITS) + 1, np.int64)
        for batch in batches:
            for part in slices(batch, column=0):
                for text in part.column(0).to_pylist():
                    if text is not None:
                        held[gram_counts(text)[0]] += 1
                        held[-1] += 1
        found = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(held[found])], ["feature", "n"])

    counted = letters.select("letters").mapInArrow(run, "feature int, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros((1 << BITS) + 1)
    n[counted.column("feature").to_numpy()] = counted.column("n").to_numpy()
    return (np.log((1 + n[-1]) / (1 + n[:-1])) + 1).astype(np.float32)


def train(documents: DataFrame, allowed: Column, most_docs: int = TRAIN_DOCS, most_chars: int = TRAIN_CHARS) -> LanguageModel:
    """The model of the rows of (doc_id, text, lang) that `allowed` admits and that have a language and a letter."""
    rows = documents.where(allowed & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text")
    texts, langs = row_sample(rows, "lang", most_docs, most_chars, shown=letters_of)
    return fit(texts, langs, inverse_frequencies(rows.select(letters_of(F.col("text")).alias("letters"))))


def identify(df: DataFrame, model: LanguageModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` with `lang_pred` and `score`; columns that have these names give way."""
    token, sent = uuid.uuid4().hex, df.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in keep if c not in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if token not in KEPT:
            KEPT.clear()
            KEPT[token] = sent.value.scorer()
        score = KEPT[token]
        for batch in batches:
            for part in slices(batch, column=0):
                names, scores = zip(*map(score, part.column(0).to_pylist()))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    schema = df.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return df.select(letters_of(F.col(text_col)).alias("_letters"), *keep).mapInArrow(run, schema)
