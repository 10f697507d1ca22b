"""Vectors of passages: offline embeddings by hashing, cosine search in blocks, redundancy."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as fn
from . import lexical


def hashed(passages: DataFrame, key: str = "chunk_id", text: str = "texto", dim: int = 64) -> DataFrame:
    """(key, vetor): counts of tokens by md5 bucket, the embedder that needs no model. Texts without tokens have no vector."""
    kind = passages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[str, int] = {}
        for b in batches:
            counts, rows = np.zeros((b.num_rows, dim)), []
            for i, t in enumerate(b.column(1).to_pylist()):
                for token, n in Counter(fn.token_list(t or "")).items():
                    at = place.get(token)
                    if at is None:
                        if len(place) > 1_000_000:
                            place.clear()
                        at = place[token] = int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dim
                    counts[i, at] += n
                if counts[i].any():
                    rows.append(i)
            values = pa.array(counts[rows].ravel())
            offsets = pa.array(np.arange(len(rows) + 1) * dim, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.ListArray.from_arrays(offsets, values)], [key, "vetor"])

    return passages.select(key, text).mapInArrow(run, f"{key} {kind}, vetor array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(fn.col(a), fn.col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 where a vector is zero."""
    return F.coalesce(dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0)), F.lit(0.0))


def search(questions: DataFrame, collection: DataFrame, k: int, floor: float = 0.0, block: int = 4096) -> DataFrame:
    """(consulta_id, vetor) against (chunk_id, vetor): the k most similar by cosine, in blocks of both sides.

    Each side is dealt into blocks of bounded size by the other's number of blocks, so no task holds a whole side."""
    qn, cn = (max(1, -(-df.count() // block)) for df in (questions, collection))

    def dealt(df: DataFrame, key: str, own: str, n: int, other: str, m: int) -> DataFrame:
        return df.select(F.col(key), "vetor", F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other))

    q, c = dealt(questions, "consulta_id", "qb", qn, "cb", cn), dealt(collection, "chunk_id", "cb", cn, "qb", qn)
    kind = questions.schema["consulta_id"].dataType.simpleString()

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        values = pa.concat_arrays(column.chunks)
        return np.asarray(values.flatten(), np.float64).reshape(len(values), -1)

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, names = left.column("consulta_id"), right.column("chunk_id")
        rows: list[np.ndarray] = []
        places: list[np.ndarray] = []
        scores: list[np.ndarray] = []
        if left.num_rows and right.num_rows:
            x, y = matrix(left.column("vetor")), matrix(right.column("vetor"))
            name = np.array(names.to_pylist())
            norm = np.sqrt((y**2).sum(1))
            for a in range(0, len(x), 256):
                part = x[a : a + 256]
                size = np.sqrt((part**2).sum(1))[:, None] * norm[None, :]
                s = np.round(np.divide(part @ y.T, size, out=np.zeros_like(size), where=size > 0), 9)
                edge = np.partition(s, -min(k, s.shape[1]), axis=1)[:, -min(k, s.shape[1])]
                i, j = np.nonzero(s >= edge[:, None])  # the k best and whatever ties with the last of them
                order = np.lexsort((name[j], -s[i, j], i))
                i, j = i[order], j[order]
                keep = np.arange(len(i)) - np.searchsorted(i, i) < k
                rows.append(i[keep] + a)
                places.append(j[keep])
                scores.append(s[i[keep], j[keep]])
        flat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return pa.table({"consulta_id": ids.take(pa.array(flat(rows, np.int64))), "chunk_id": names.take(pa.array(flat(places, np.int64))), "score": pa.array(flat(scores, np.float64))})

    keys = ["qb", "cb"]
    found = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(best, f"consulta_id {kind}, chunk_id string, score double")
    if floor > 0:
        found = found.filter(F.col("score") >= floor)
    return lexical.ranked(found, k)


def drop_redundant(items: DataFrame, limit: float = 0.95) -> DataFrame:
    """(consulta_id, ordem, vetor): an item goes if it is too like one accepted before it. A fold over each small list."""
    if limit >= 1:
        return items
    one = F.struct(*items.columns)
    kept = F.aggregate(
        F.array_sort(F.collect_list(F.struct(F.col("ordem").alias("o"), one.alias("x")))),
        F.array().cast(f"array<struct<o:{items.schema['ordem'].dataType.simpleString()},x:{items.schema.simpleString()}>>"),
        lambda acc, x: F.when(F.exists(acc, lambda y: cosine(x["x"]["vetor"], y["x"]["vetor"]) > limit), acc).otherwise(F.concat(acc, F.array(x))),
    )
    return items.groupBy("consulta_id").agg(kept.alias("kept")).select(F.explode("kept").alias("k")).select("k.x.*")
