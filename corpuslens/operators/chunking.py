"""Cutting texts into passages by greedy packing, a batch of documents at a time."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARAGRAPHS = r"\n\s*\n"
SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
PASSAGE = "chunk_id string, texto string, documento_origem string, titulo_pagina string, chunk_index int"

Strategy = Callable[..., list[str]]


def pack(items: Iterable[str], most: int, separator: str) -> list[str]:
    """Join neighbours with the separator as long as they fit; an item that is too long stays alone."""
    done, held, size = [], [], 0
    for x in items:
        if size and size + len(separator) + len(x) > most:
            done.append(separator.join(held))
            held, size = [], 0
        if size:
            held.append(x)
            size += len(separator) + len(x)
        else:
            held, size = [x], len(x)
    return [*done, separator.join(held)] if size else done


def split_giant(text: str, most: int) -> list[str]:
    """An oversized paragraph: by sentences, then words, then fixed slices."""
    pieces: list[str] = []
    for sentence in pack(SENTENCE_END.split(text), most, " "):
        for run in [sentence] if len(sentence) <= most else pack(sentence.split(" "), most, " "):
            pieces += [run] if len(run) <= most else [run[i : i + most] for i in range(0, len(run), most)]
    return [p for p in map(str.strip, pieces) if p]


def paragraphs(body: str, pattern: str = PARAGRAPHS) -> list[str]:
    return [p.strip() for p in re.split(pattern, body)]


def by_paragraph(body: str, least: int = 60, most: int = 2000, pattern: str = PARAGRAPHS) -> list[str]:
    """Short paragraphs go, long ones are split; pieces that come out short go too."""
    fit = (p for p in paragraphs(body, pattern) if len(p) >= least)
    return [x for p in fit for x in ([p] if len(p) <= most else split_giant(p, most)) if len(x) >= least]


def grouped(body: str, least: int = 60, most: int = 2000, pattern: str = PARAGRAPHS) -> list[str]:
    """Neighbouring paragraphs share a passage while they fit; an oversized one closes it and comes apart by itself."""
    out: list[str] = []
    run: list[str] = []
    for p in filter(None, paragraphs(body, pattern)):
        if len(p) <= most:
            run.append(p)
            continue
        out += pack(run, most, "\n\n") + split_giant(p, most)
        run = []
    return [x for x in out + pack(run, most, "\n\n") if len(x) >= least]


STRATEGIES: dict[str, Strategy] = {"paragrafo": by_paragraph, "paragrafo_agrupado": grouped}


def chunks(docs: DataFrame, strategy: str = "paragrafo_agrupado", least: int = 60, most: int = 2000, pattern: str = PARAGRAPHS) -> DataFrame:
    """(documento_origem, titulo_pagina, corpo) -> one row a passage, numbered from 0 in its document; a null body has none."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known: {', '.join(sorted(STRATEGIES))}")
    cutter = STRATEGIES[strategy]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                names, texts = b.column(0).to_pylist(), []
                ids, row, nth = [], [], []
                for i, body in enumerate(b.column(2).to_pylist()):
                    found = cutter(body, least, most, pattern) if body is not None else []
                    head = "" if names[i] is None else f"{names[i]}::"
                    texts += found
                    ids += [f"{head}{k}" for k in range(len(found))]
                    nth += range(len(found))
                    row += [i] * len(found)
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string()), b.column(0).take(take), b.column(1).take(take), pa.array(nth, pa.int32())], ["chunk_id", "texto", "documento_origem", "titulo_pagina", "chunk_index"])

    return docs.select(F.col("documento_origem").cast("string"), F.col("titulo_pagina").cast("string"), F.col("corpo").cast("string")).mapInArrow(run, PASSAGE)


def statistics(passages: DataFrame, most: int = 2000) -> DataFrame:
    n = F.length("texto")
    return passages.agg(F.count("*").alias("trechos"), F.count_distinct("documento_origem").alias("documentos"), F.min(n).alias("menor"), F.floor(F.sum(n) / F.count("*")).alias("media"), F.max(n).alias("maior"), F.count_if(n > most).alias("acima_do_teto"))


def oversized(passages: DataFrame, most: int = 2000) -> DataFrame:
    """(chunk_id, n) of the passages over the limit, longest first."""
    n = F.length("texto")
    return passages.select("chunk_id", n.alias("n")).filter(F.col("n") > most).orderBy(F.col("n").desc(), "chunk_id")
