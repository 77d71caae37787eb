"""Document quality by a linear-chain conditional random field over lines.

Every line that isn't blank is a node, good or bad. Its features are binned shape and repetition
measures of itself and of its neighbouring lines; training lines carry their document's label, from a
bounded, hash-ordered sample. Forward-backward gives each line's probability of being good, and the
document's score is their mean weighted by line length.

Null, empty and blank texts score the share of good documents in training. Very long texts are
scored whole, all their lines in one chain. Repeated rows score alike. Without training rows every
score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Labelled documents that training takes at most.
TRAIN_DOCS = 6000
RATIO_BINS = np.array([1e-9, 0.02, 0.05, 0.1, 0.2, 0.35, 0.6])
COUNT_BINS = np.array([2, 4, 8, 16, 32, 64, 128])
LENGTH_BINS = np.array([2, 3, 4, 5, 6, 8, 12])
FEATURES = ("upper", "symbol", "digit", "pipe", "bang", "high", "echo", "seen", "again", "repeat", "mean_length", "words")
BINS = 9  #: the last one stands for no line there
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_MULTIPLIER = 0x9E3779B97F4A7C15
SCORED_BYTES = 1 << 20


def _kind(members) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


_UPPER, _LOWER, _DIGIT = _kind(range(65, 91)), _kind(range(97, 123)), _kind(range(48, 58))
_SYMBOL = _kind(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,'\"|!")


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x100000001B3
    with np.errstate(over="ignore"):
        up = np.full(n, base, np.uint64)
        down = np.full(n, pow(base, -1, 1 << 64), np.uint64)
        up[:1] = down[:1] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _seen_before(key: np.ndarray) -> np.ndarray:
    """Whether an equal key stands earlier."""
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    return np.arange(len(key)) != first[inverse]


def lines_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document of each line, its bytes, feature bins as lines x features) of the lines that aren't blank."""
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"".join(r + b"\n" for r in raw), np.uint8)
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, len(FEATURES)), np.int64)
    doc_ends = np.cumsum([len(r) + 1 for r in raw])
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    gap = _SPACE[data]
    before = np.concatenate([[True], gap[:-1]])
    word_start = np.flatnonzero(~gap & before)
    word_end = np.flatnonzero(gap & ~before)
    word_line = np.searchsorted(ends, word_start, "right")
    n_words = np.bincount(word_line, minlength=len(ends))
    keep = n_words > 0
    doc = np.searchsorted(doc_ends, starts, "right")

    def total(table: np.ndarray) -> np.ndarray:
        running = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
        return running[ends] - running[starts]

    with np.errstate(over="ignore"):
        up, down = _powers(len(data))
        hashed = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)])
        word = (hashed[word_end] - hashed[word_start]) * down[word_start] * np.uint64(_MULTIPLIER)
        whole = (hashed[ends] - hashed[starts]) * down[starts] * np.uint64(_MULTIPLIER)
        salt = (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        line_salt = (word_line.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F)
        three = word.copy()
        three[2:] += word[1:-1] * np.uint64(3) + word[:-2] * np.uint64(7)
        echo = np.zeros(len(word), bool)
        echo[1:] = (word[1:] == word[:-1]) & (word_line[1:] == word_line[:-1])
        again = _seen_before(word ^ line_salt)
        seen = _seen_before(three ^ salt[word_line])
        repeat = np.zeros(len(ends), bool)
        repeat[keep] = _seen_before((whole ^ salt)[keep])
    n = np.maximum(1, n_words)
    length = ends - starts
    part = lambda flags: np.bincount(word_line[flags], minlength=len(ends)) / n
    letters = np.maximum(1, total(_UPPER | _LOWER))
    measures = {
        "upper": total(_UPPER) / letters, "symbol": total(_SYMBOL) / np.maximum(1, length), "digit": total(_DIGIT) / np.maximum(1, length),
        "pipe": total(_kind([124])) / n, "bang": total(_kind([33])) / n, "high": total(_kind(range(128, 256))) / np.maximum(1, length),
        "echo": part(echo), "seen": part(seen), "again": part(again), "repeat": repeat.astype(float),
    }
    bins = [np.digitize(measures[f], RATIO_BINS) for f in FEATURES[:-2]]
    bins += [np.digitize((length - n_words + 1) / n, LENGTH_BINS), np.digitize(n_words, COUNT_BINS)]
    return doc[keep], length[keep], np.stack(bins, 1)[keep]


def neighbours(doc: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Feature indices of each line: of the line before, itself and the line after."""
    n, k = bins.shape
    none = np.full((1, k), BINS - 1)
    same = np.concatenate([[False], doc[1:] == doc[:-1]]) if n else np.empty(0, bool)
    before = np.where(same[:, None], np.concatenate([none, bins[:-1]]), none)
    after = np.where(np.concatenate([same[1:], [False]])[:, None] if n else same[:, None], np.concatenate([bins[1:], none]), none)
    at = np.arange(k) * BINS
    return np.concatenate([before + at, bins + at + k * BINS, after + at + 2 * k * BINS], 1)


def forward_backward(emission: np.ndarray, doc: np.ndarray, transition: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability of good at each line, expected transitions 2 x 2) of all chains at once, position by position."""
    n = len(emission)
    if not n:
        return np.empty(0), np.zeros((2, 2))
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    sizes = np.diff(np.concatenate([first, [n]]))
    order = np.argsort(-sizes, kind="stable")
    first, sizes = first[order], sizes[order]
    node = np.exp(np.stack([np.minimum(0, -emission), np.minimum(0, emission)], 1))  # scaled by their larger one
    step, begin = np.exp(transition - transition.max()), np.exp(start - start.max())
    alpha, beta = np.empty((n, 2)), np.ones((n, 2))
    most = int(sizes[0])
    active = [int(np.searchsorted(-sizes, -t, "left")) for t in range(most + 1)]  # chains longer than t
    for t in range(most):
        rows = first[: active[t]] + t
        a = node[rows] * (begin if t == 0 else alpha[rows - 1] @ step)
        alpha[rows] = a / a.sum(1, keepdims=True)
    pairs = np.zeros((2, 2))
    for t in range(most - 2, -1, -1):
        rows = first[: active[t + 1]] + t
        b = (node[rows + 1] * beta[rows + 1]) @ step.T
        both = alpha[rows][:, :, None] * step * (node[rows + 1] * beta[rows + 1])[:, None, :]
        pairs += (both / both.sum((1, 2), keepdims=True)).sum(0)
        beta[rows] = b / b.sum(1, keepdims=True)
    p = alpha * beta
    return p[:, 1] / p.sum(1), pairs


@dataclass
class QualityModel:
    weights: np.ndarray
    transition: np.ndarray
    start: np.ndarray
    prior: float = 0.5

    def scorer(self) -> "QualityModel":
        return self

    def line_scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, bytes, probability of good) of each line that isn't blank."""
        doc, length, bins = lines_of(texts)
        p, _ = forward_backward(self.weights[neighbours(doc, bins)].sum(1), doc, self.transition, self.start)
        return doc, length, p

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        doc, length, p = self.line_scores(texts)
        weight = np.bincount(doc, length, len(texts))
        return np.where(weight > 0, np.bincount(doc, length * p, len(texts)) / np.maximum(weight, 1e-9), self.prior)


def fit(texts: list[str | None], labels: np.ndarray, steps: int = 120, l2: float = 1e-4, rate: float = 0.1) -> QualityModel:
    """Fit on a sample that fits in memory; a document's lines weigh together as much as any other's."""
    y = np.asarray(labels, float)
    model = QualityModel(np.zeros(3 * len(FEATURES) * BINS), np.zeros((2, 2)), np.zeros(2), float(y.mean()) if len(y) else 0.5)
    parts, at = [], 0
    while at < len(texts):  # a bounded share of the sample's bytes at a time
        end, held = at, 0
        while end < len(texts) and (end == at or held < SCORED_BYTES):
            held += len(texts[end] or "")
            end += 1
        doc, _, bins = lines_of(texts[at:end])
        parts.append((doc + at, bins.astype(np.int16)))
        at = end
    doc, bins = (np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, np.int64), None)
    if not len(doc):
        return model
    index = neighbours(doc, bins)
    n_docs = len(np.unique(doc))
    good = y[doc]
    same = doc[1:] == doc[:-1]
    truth = np.zeros((2, 2))
    np.add.at(truth, (good[:-1][same].astype(int), good[1:][same].astype(int)), 1)
    starts = np.concatenate([[True], doc[1:] != doc[:-1]])
    theta = [model.weights, model.transition, model.start]
    m, v = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]
    for t in range(1, steps + 1):
        p, pairs = forward_backward(theta[0][index].sum(1), doc, theta[1], theta[2])
        error = p - good
        per_start = error[starts].sum()
        grads = [np.bincount(index.ravel(), np.repeat(error, index.shape[1]), len(theta[0])), pairs - truth, np.array([-per_start, per_start])]
        for i, g in enumerate(grads):
            g = g / n_docs + l2 * theta[i]
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            theta[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return model
