"""Toxicity scores: logistic regression over hashed word n-grams and skip-grams, fitted by follow-the-regularised-leader.

Words are lower-cased (A-Z) and lose ASCII punctuation at either end. A text's features are indicators of its words
(and of longer words' first four bytes), its pairs of neighbours and its pairs with one word between. Every coordinate has its own rate; L1 keeps most weights
at exactly zero, so that only the few others are broadcast.

Bounds: fitted on at most `limit` labelled documents (8000; documented parameter), several times over. Defined results:
empty or null text has no features, so its score is the sigmoid of the intercept; without training rows, or with one
class only, every score is the class share (one half without rows); labels other than 0 and 1 are not learned.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .common import LOWER_ASCII, mix, word_hashes, word_spans
from .labelled import distinct_by_row, held_out, score_table, training_sample

BITS = 20
_EDGE = np.zeros(256, bool)
_EDGE[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_NEXT, _SKIP, _STEM = np.uint64(0x5851F42D4C957F2D), np.uint64(0xD1342543DE82EF95), np.uint64(0x2545F4914F6CDD1D)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All features of all texts, repeats included: (feature, row)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, ends, rows = word_spans(data, offsets)
    lower = LOWER_ASCII[data]
    while len(starts):
        left = (ends > starts) & _EDGE[lower[np.minimum(starts, len(lower) - 1)]]
        right = (ends - left > starts) & _EDGE[lower[np.maximum(ends - 1, 0)]]
        if not left.any() and not right.any():
            break
        starts, ends = starts + left, ends - (right & (ends - 1 >= starts + left))
    full = ends > starts
    starts, ends, rows = starts[full], ends[full], rows[full]
    h = word_hashes(lower, starts, ends)
    long = np.flatnonzero(ends - starts > 5)
    parts, where = [h, mix(word_hashes(lower, starts[long], starts[long] + 4) + _STEM)], [rows, rows[long]]
    for gap, base in ((1, _NEXT), (2, _SKIP)):
        if len(h) > gap:
            at = np.flatnonzero(rows[:-gap] == rows[gap:])
            parts.append(mix(h[at] * base + h[at + gap]))
            where.append(rows[at])
    return (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(where)


def extract(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    f, r = features(data, offsets)
    return distinct_by_row(f, r, BITS)


def ftrl(rows: list[np.ndarray], y: np.ndarray, alpha: float = 3.0, beta: float = 1.0, l1: float = 5.0, l2: float = 0.1, epochs: int = 8, seed: int = 0) -> tuple[np.ndarray, float]:
    """FTRL-proximal, one text at a time; the weight of a coordinate is made from its z and n when it is met."""
    size = 1 << BITS
    z, n, rng = np.zeros(size), np.zeros(size), np.random.default_rng(seed)
    zb = nb = 0.0
    b = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    start = b

    def weights(zz: np.ndarray, nn: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            r = rows[i]
            zz, nn = z[r], n[r]
            w = weights(zz, nn)
            b = start - zb / ((beta + nb**0.5) / alpha)
            g = 1 / (1 + np.exp(-min(max(float(w.sum()) + b, -35), 35))) - y[i]
            root = np.sqrt(nn + g * g)
            z[r] = zz + g - (root - np.sqrt(nn)) / alpha * w
            n[r] = nn + g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / alpha * (b - start)
            nb += g * g
    return weights(z, n), start - zb / ((beta + nb**0.5) / alpha)


class Model:
    """Non-zero weights only: their sorted feature numbers and values."""

    def __init__(self, rows: list[np.ndarray], y: np.ndarray, seed: int = 0):
        self.at, self.value = np.zeros(0, np.int64), np.zeros(0)
        if len(y) < 6 or y.min() == y.max():
            share = (y.sum() + 1) / (len(y) + 2)
            self.bias = float(np.log(share / (1 - share)))
            return
        w, self.bias = ftrl(rows, y, seed=seed)
        self.at = np.flatnonzero(w)
        self.value = w[self.at]

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << BITS, np.float32)
        w[self.at] = self.value
        return w

    def margins(self, dense: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        f, r = features(data, offsets)
        live = dense[f] != 0  # repeats need to be found among these only
        f, r = distinct_by_row(f[live], r[live], BITS)
        return self.bias + np.bincount(r, weights=dense[f].astype(float), minlength=len(offsets) - 1)


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = 8000, seed: int = 6) -> DataFrame:
    """doc_id, held_out, score, predicted. Learns from rows whose crc32(doc_id) mod 3 is not 1."""
    out = held_out(3, 1)
    model = docs.sparkSession.sparkContext.broadcast(Model(*training_sample(docs, labels, label, out, extract, limit, seed), seed=seed))
    memo: dict[int, np.ndarray] = {}

    def margins(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if 0 not in memo:
            memo[0] = model.value.dense()
        return model.value.margins(memo[0], data, offsets)

    return score_table(docs, out, margins)
