"""Inverted index and BM25 over a whole table of questions at once. Building writes the index; searching reads it."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fn
from ..sources.shared import cut

K1, B, DEFAULT_K = 1.5, 0.75, 10
FEW = 200_000  # so many tokens of questions are broadcast


@dataclass
class Index:
    """postings (token, chunk_id, tf, dl), terms (token, df, cf) and two numbers: passages, and their mean size in tokens."""

    postings: DataFrame
    terms: DataFrame
    n: int
    mean: float


def postings(passages: DataFrame) -> DataFrame:
    """(token, chunk_id, tf, dl): a passage's tokens are counted where its text is, so nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, tf, dl, size = [], [], [], []
            for text in b.column(1).to_pylist():
                found = fn.token_list(text or "")
                counts = Counter(found)
                tokens += counts.keys()
                tf += counts.values()
                dl += [len(found)] * len(counts)
                size.append(len(counts))
            row = pa.array([i for i, k in enumerate(size) for _ in range(k)], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), b.column(0).take(row), pa.array(tf, pa.int64()), pa.array(dl, pa.int32())], ["token", "chunk_id", "tf", "dl"])

    return passages.select("chunk_id", "texto").mapInArrow(run, "token string, chunk_id string, tf long, dl int")


def build(passages: DataFrame) -> Index:
    """Written once: postings in the order of their tokens inside each file, so that a search skips most of a file; and the terms."""
    written = cut(postings(passages).sortWithinPartitions("token"))
    terms = cut(written.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")))
    n, total = passages.count(), terms.agg(F.sum("cf")).first()[0] or 0
    return Index(written, terms, n, total / n if n else 0.0)


def search(index: Index, questions: DataFrame, k: int = DEFAULT_K, text: str = "texto") -> DataFrame:
    """(consulta_id, texto) -> (consulta_id, posicao, chunk_id, score): passages that share a token, best first."""
    asked = questions.select("consulta_id", F.explode(F.array_distinct(fn.tokens(text))).alias("token"))
    idf = F.log(1 + (index.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = asked.join(index.terms, "token").select("consulta_id", "token", idf.alias("idf"))
    if asked.count() <= FEW:
        weighted = F.broadcast(weighted)
    norm = F.lit(1.0) if index.mean == 0 else 1 - B + B * F.col("dl") / index.mean
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * norm)
    total = index.postings.join(weighted, "token").groupBy("consulta_id", "chunk_id").agg(F.sum(part).alias("score"))
    return ranked(total, k)


def ranked(scored: DataFrame, k: int | None, tie: str = "chunk_id") -> DataFrame:
    """Positions by score (rounded, so that sums in another order rank alike), ties by key."""
    by = Window.partitionBy("consulta_id").orderBy(F.round("score", 9).desc(), F.col(tie))
    out = scored.withColumn("posicao", F.row_number().over(by))
    out = out if k is None else out.filter(F.col("posicao") <= k)
    return out.select("consulta_id", "posicao", "chunk_id", "score")
