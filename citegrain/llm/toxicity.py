"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A document's features are the n-grams of its distinct lower-cased words, each word between spaces,
hashed to a fixed table; a feature counts the distinct words that hold it, so that length and
repetition don't drown a few telling words. Training takes a bounded, hash-ordered sample of the
labelled documents (`TRAIN_DOCS`), computes each feature's log-count ratio between the classes and
fits an L2-regularised logistic regression to the scaled features. So many features fit any sample
without error, which leaves scores too near to the commoner class: a line through the log-odds that a
model of one half gives the other half puts them right.

Null and empty texts have no features and score the bias alone; very long texts are scored whole.
Repeated rows score alike. A training table without both classes gives the constant model of its mean.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that training takes at most, the first in the order of a hash of their ids.
TRAIN_DOCS = 6000
ORDERS, BITS = (2, 3, 4, 5), 18
REMEMBERED_WORDS = 250_000
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def gram_ids(words: list[str], share: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams of each word, hashed n-grams one word after another) of non-empty words."""
    n, ids = [], [np.empty(0, np.int32)]
    for at in range(0, len(words), share):
        told: list[int] = []
        for word in words[at : at + share]:
            padded = f" {word} ".encode()
            found = {xxhash.xxh32_intdigest(padded[i : i + k]) & (1 << BITS) - 1 for k in ORDERS for i in range(len(padded) - k + 1)}
            n.append(len(found))
            told.extend(found)
        ids.append(np.array(told, np.int32))
    return np.array(n, np.int32), np.concatenate(ids)


@dataclass
class ToxicityModel:
    weights: np.ndarray  #: by n-gram, times its log-count ratio
    bias: float

    def scorer(self) -> "Scorer":
        return Scorer(self)


class Scorer:
    """Scores documents; remembers the sums of a bounded number of words."""

    def __init__(self, model: ToxicityModel):
        self.model, self.words = model, {}

    def log_odds(self, texts: list[str | None]) -> np.ndarray:
        found = [words_of(t) for t in texts]
        fresh = list(set().union(*found) - self.words.keys())
        if len(self.words) + len(fresh) > REMEMBERED_WORDS:
            self.words.clear()
            fresh = list(set().union(*found))
        if fresh:
            n, ids = gram_ids(fresh)
            sums = np.add.reduceat(self.model.weights[ids], np.cumsum(n) - n)
            self.words.update(zip(fresh, sums.tolist()))
        get = self.words.__getitem__
        return np.array([sum(map(get, ws)) / np.sqrt(max(1, len(ws))) for ws in found]) + self.model.bias

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(texts), -60, 60)))


def without_labels() -> ToxicityModel:
    """The model of a query whose training table has no rows: nothing says that any document is toxic."""
    return ToxicityModel(np.zeros(1 << BITS), float(np.log(1e-3 / (1 - 1e-3))))


def calibration(log_odds: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """(slope, offset) of the likeliest probabilities 1 / (1 + exp(-(slope * log-odds + offset))), held near (1, 0)."""
    slope, offset = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(slope * log_odds + offset, -60, 60)))
        h = p * (1 - p)
        gradient = np.array([((p - y) * log_odds).sum() + 0.1 * (slope - 1), (p - y).sum() + 0.1 * offset])
        cross = (h * log_odds).sum()
        step = np.linalg.solve(np.array([[(h * log_odds**2).sum() + 0.1, cross], [cross, h.sum() + 0.1]]), gradient)
        step /= max(1.0, np.abs(step).max())
        slope, offset = slope - step[0], offset - step[1]
    return (slope, offset) if slope > 0 else (1.0, 0.0)


def fit(texts: list[str | None], labels: np.ndarray, **how) -> ToxicityModel:
    """Fit on a sample that fits in memory, with log-odds put right where both halves hold both classes."""
    y = np.asarray(labels, float)
    part = np.arange(len(y)) % 2 == 0
    slope, offset = 1.0, 0.0
    if all(len(h) and h.min() < h.max() for h in (y[part], y[~part])):
        score = uncalibrated([t for t, on in zip(texts, part) if on], y[part], **how).scorer()
        slope, offset = calibration(score.log_odds([t for t, on in zip(texts, part) if not on]), y[~part])
    model = uncalibrated(texts, y, **how)
    return ToxicityModel(model.weights * np.float32(slope), model.bias * slope + offset)


def uncalibrated(texts: list[str | None], y: np.ndarray, steps: int = 100, l2: float = 1e-3, alpha: float = 1.0, rate: float = 0.05) -> ToxicityModel:
    """Fit by Adam steps on all rows at once."""
    names: dict[str, str] = {}  # one object for each word, however many documents hold it
    docs = [[names.setdefault(w, w) for w in sorted(words_of(t))] for t in texts]
    del names
    if len(y) == 0 or y.min() == y.max():
        p = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        return ToxicityModel(np.zeros(1 << BITS), float(np.log(p / (1 - p))))
    vocabulary = sorted(set().union(*docs))
    place = dict(zip(vocabulary, range(len(vocabulary))))
    n_words = np.array([len(d) for d in docs])
    row = np.repeat(np.arange(len(docs), dtype=np.int32), n_words)
    word = np.fromiter((place[w] for d in docs for w in d), np.int32, int(n_words.sum()))
    n_docs, n_vocabulary = len(docs), len(vocabulary)
    del docs, place
    n, gram = gram_ids(vocabulary)
    del vocabulary
    owner = np.repeat(np.arange(n_vocabulary, dtype=np.int32), n)
    scale = 1 / np.sqrt(np.maximum(1, n_words))

    def down(per_doc: np.ndarray) -> np.ndarray:
        """Sums over documents to sums over n-grams."""
        per_word = np.bincount(word, per_doc[row], n_vocabulary)
        return np.bincount(gram, per_word[owner], 1 << BITS)

    toxic, clean = down(scale * y) + alpha, down(scale * (1 - y)) + alpha
    ratio = np.log(toxic / toxic.sum()) - np.log(clean / clean.sum())
    theta, bias = np.zeros(1 << BITS), float(np.log(y.mean() / (1 - y.mean())))
    m, v, mb, vb = np.zeros_like(theta), np.zeros_like(theta), 0.0, 0.0
    for t in range(1, steps + 1):
        per_word = np.bincount(owner, (theta * ratio)[gram], n_vocabulary)
        z = np.bincount(row, per_word[word], n_docs) * scale + bias
        error = 1 / (1 + np.exp(-np.clip(z, -60, 60))) - y
        g = down(error * scale) * ratio / len(y) + l2 * theta
        gb = error.mean()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a, b = 1 - 0.9**t, 1 - 0.999**t
        theta -= rate * (m / a) / (np.sqrt(v / b) + 1e-8)
        bias -= rate * (mb / a) / (np.sqrt(vb / b) + 1e-8)
    return ToxicityModel((theta * ratio).astype(np.float32), float(bias))
