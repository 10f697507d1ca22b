"""What the two linear text classifiers share: the bounded sample of labelled rows, and calibrated scoring of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc32_of_id, flat, slices

# (bytes, offsets) of some texts -> (feature numbers, row numbers), distinct within a row and in row order.
Extractor = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def held_out(modulus: int, remainder: int) -> Column:
    return F.coalesce(F.pmod(crc32_of_id(), F.lit(modulus)) == remainder, F.lit(False))


def distinct_by_row(features: np.ndarray, rows: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (feature, row) pairs, sorted by row; 32-bit keys where the rows fit, as these sort faster."""
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = np.uint32 if int(rows.max()) < 1 << (32 - bits) else np.uint64
    both = rows.astype(kind) << kind(bits) | features.astype(kind)
    both.sort()
    new = np.ones(len(both), bool)
    np.not_equal(both[1:], both[:-1], out=new[1:])
    both = both[new]
    return (both & kind((1 << bits) - 1)).astype(np.int64), (both >> kind(bits)).astype(np.int64)


def training_sample(docs: DataFrame, labels: DataFrame, label: str, out: Column, extract: Extractor, limit: int, seed: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and labels (0/1) of at most `limit` labelled documents outside the held-out fold, by a hash of their ids.

    Of a document labelled twice the larger label counts; other label values than 0 and 1 and null ones do not. Of rows with one id the
    least text is learned, so that no more than `limit` rows reach the driver however often an id repeats."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("y").alias("y"))
    known = known.filter(~out).orderBy(F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")), "doc_id").limit(limit)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = flat(b.column("text"))
            found: list[bytes] = []
            for a, z in slices(offsets, 1 << 20):
                f, r = extract(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a])
                edge = np.searchsorted(r, np.arange(z - a + 1))
                found += [f[edge[i] : edge[i + 1]].astype("<u4").tobytes() for i in range(z - a)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(found, pa.binary())], ["doc_id", "y", "f"])

    got = rows.mapInArrow(run, "doc_id long, y int, f binary").collect()  # `limit` rows at most
    got.sort(key=lambda r: (r["doc_id"], r["f"]))
    return [np.frombuffer(r["f"], "<u4") for r in got], np.array([r["y"] for r in got], float)


def platt(margin: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """a, b of P(1) = 1 / (1 + exp(-(a m + b))), by Newton's method on smoothed targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = max(float(np.abs(margin).std()), 1e-9)
    x = np.stack([margin / scale, np.ones(len(y))], 1)
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
        w = w + np.clip(np.linalg.solve(h, x.T @ (t - p) - 1e-4 * w), -5, 5)
    return float(w[0] / scale), float(w[1])


def score_table(docs: DataFrame, out: Column, margins: Callable[[np.ndarray, np.ndarray], np.ndarray], threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text. `margins` gives the log-odds of each text of a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = flat(b.column("text"))
            m = np.zeros(b.num_rows)
            for a, z in slices(offsets, 1 << 20):
                m[a:z] = margins(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a])
            score = 1 / (1 + np.exp(-np.clip(m, -40, 40)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
