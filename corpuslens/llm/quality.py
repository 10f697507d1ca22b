"""Quality scores from naive Bayes support vectors.

A text's features are indicators of its hashed byte trigrams and its words. Each indicator is
scaled by its class log-count ratio; on the scaled, length-normalised vectors a linear model with hinge loss is fitted
by dual coordinate descent. Margins of three folds left out in turn give the sigmoid that turns a margin into a score.

Bounds: fitted on at most `limit` labelled documents (6000; documented parameter). Defined results: empty or null text
has no features, so its score is the sigmoid at the intercept; without training rows, or with one class only, every
score is the class share (one half without rows); labels other than 0 and 1 are not learned.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .common import word_hashes, word_spans
from .labelled import distinct_by_row, held_out, platt, score_table, training_sample

BITS = 18


def extract(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte trigrams and words, hashed to BITS bits; distinct within each text."""
    if len(data) < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    b = data.astype(np.uint32)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint32), np.diff(offsets))
    tri, of = np.zeros(0, np.uint32), row[:0]
    if len(b) > 2:
        tri = b[:-2] << np.uint32(16)
        tri |= b[1:-1] << np.uint32(8)
        tri |= b[2:]
        tri *= np.uint32(0x9E3779B1)
        tri >>= np.uint32(32 - BITS)
        whole = row[:-2] == row[2:]
        tri, of = (tri, row[:-2]) if whole.all() else (tri[whole], row[:-2][whole])
    starts, ends, rows = word_spans(data, offsets)
    h = word_hashes(data, starts, ends)
    f = np.concatenate([tri, (h >> np.uint64(64 - BITS)).astype(np.uint32)])
    return distinct_by_row(f, np.concatenate([of, rows.astype(np.uint32)]), BITS)


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """ln of the features' shares of class 1 over those of class 0, each count raised by alpha; 0 for unseen features."""
    count = [np.bincount(np.concatenate([r for r, k in zip(rows, y, strict=True) if k == c] or [np.zeros(0, np.int64)]), minlength=1 << BITS) for c in (0, 1)]
    share = [(n + alpha) / (n + alpha).sum() for n in count]
    return np.where(count[0] + count[1] > 0, np.log(share[1] / share[0]), 0.0)


def fit_hinge(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = 1.0, epochs: int = 12, seed: int = 0) -> tuple[np.ndarray, float]:
    """min |w|^2 / 2 + C sum max(0, 1 - y w.x) over unit vectors x = ratio / |ratio| and a constant, one dual variable at a time."""
    w, bias, sign = np.zeros(len(ratio)), 0.0, np.where(y > 0, 1.0, -1.0)
    balance = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    values = [ratio[r] for r in rows]
    values = [v / max(float(np.sqrt(v @ v)), 1e-12) for v in values]
    alpha, order, rng = np.zeros(len(y)), np.arange(len(y)), np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        moved = 0.0
        for i in order:
            r, v = rows[i], values[i]
            gradient = sign[i] * (float(w[r] @ v) + bias) - 1
            norm = float(v @ v) + 1
            new = min(max(alpha[i] - gradient / norm, 0.0), cost * balance[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                alpha[i] = new
                w[r] += step * v
                bias += step
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


class Model:
    def __init__(self, rows: list[np.ndarray], y: np.ndarray, seed: int = 0):
        self.constant = None
        if len(y) < 6 or y.min() == y.max():
            share = (y.sum() + 1) / (len(y) + 2)
            self.constant = float(np.log(share / (1 - share)))
            return
        fold, margin = np.random.default_rng(seed).permutation(len(y)) % 3, np.zeros(len(y))
        for k in range(3):
            inside = [r for r, f in zip(rows, fold, strict=True) if f != k]
            if len(set(y[fold != k])) < 2:
                continue
            ratio = log_count_ratio(inside, y[fold != k])
            w, bias = fit_hinge(inside, y[fold != k], ratio, seed=seed)
            for i in np.flatnonzero(fold == k):
                v = ratio[rows[i]]
                margin[i] = float(w[rows[i]] @ v) / max(float(np.sqrt(v @ v)), 1e-12) + bias
        self.a, self.b = platt(margin, y)
        self.ratio = log_count_ratio(rows, y)
        w, self.bias = fit_hinge(rows, y, self.ratio, seed=seed)
        self.weight, self.square = (w * self.ratio).astype(np.float32), (self.ratio**2).astype(np.float32)
        self.ratio = None

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if self.constant is not None:
            return np.full(n, self.constant)
        f, r = extract(data, offsets)
        dot = np.bincount(r, weights=self.weight[f], minlength=n)
        norm = np.sqrt(np.bincount(r, weights=self.square[f], minlength=n))
        return self.a * (dot / np.maximum(norm, 1e-12) + self.bias) + self.b


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = 6000, seed: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted. Learns from rows whose crc32(doc_id) mod 4 is not 2."""
    out = held_out(4, 2)
    model = docs.sparkSession.sparkContext.broadcast(Model(*training_sample(docs, labels, label, out, extract, limit, seed), seed=seed))
    return score_table(docs, out, lambda data, offsets: model.value(data, offsets))
