"""Removal of repeated passages.

Rabin-Karp fingerprints of every window of `window` words are counted in Spark. Documents are dealt into blocks by a hash
of doc_id; a block gives each of its distinct fingerprints once, with the least doc_id that holds it. A shuffle by the
fingerprints' first bits (buckets) counts them and finds those whose first document lies in another block; only these go
back to the blocks, which mark their windows, repeats within the block included, and merge the words that marked windows
cover into maximal removal intervals.

A passage in a third of all documents so costs one fingerprint a block, not one a document; no task holds more than a block
of text or a bucket of fingerprints, and both numbers follow the input's bytes. What travels is packed, some nine bytes a
fingerprint (as rows of two numbers it weighs a third more), in at most as many pieces as there are fingerprints.
Fingerprints have 64 bits; windows of different words are taken for equal with probability n^2 / 2^65 for n distinct ones.

Defined results: null or empty text has no words and keeps none (the digest is that of no bytes); rows with one doc_id
are one document for the comparison (none removes the other's words); a null doc_id has no smaller one and is no
smaller one, so its row is kept whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, pack_sorted, unpack_sorted, windows, word_hashes, word_spans

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, intervals array<struct<start:long,end:long>>, kept string"


class _Block:
    """A block's windows: fingerprint, first word and document of each."""

    def __init__(self, table: pa.Table, k: int):
        self.ids = table.column("doc_id").to_numpy()
        self.data, self.offsets = flat(table.column("text"))
        self.starts, self.ends, self.rows = word_spans(self.data, self.offsets)
        self.prints, self.at = windows(word_hashes(self.data, self.starts, self.ends), self.rows, k)
        self.k = k

    def firsts(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct fingerprints, ascending, and the least doc_id of each."""
        order = np.lexsort((self.ids[self.rows[self.at]], self.prints))
        prints = self.prints[order]
        new = np.ones(len(prints), bool)
        new[1:] = prints[1:] != prints[:-1]
        return prints[new], self.ids[self.rows[self.at[order[new]]]]

    def marked(self, repeated: np.ndarray) -> np.ndarray:
        """Which words some repeated window covers; `repeated` has the fingerprints that smaller documents of other blocks hold."""
        ids = self.ids[self.rows[self.at]]
        distinct, least = self.firsts()
        which = np.searchsorted(distinct, self.prints)
        if len(repeated):
            p = np.minimum(np.searchsorted(repeated, distinct), len(repeated) - 1)
            least[repeated[p] == distinct] = np.iinfo(np.int64).min
        hit = self.at[ids > least[which]]
        step = np.zeros(len(self.starts) + 1, np.int64)
        np.add.at(step, hit, 1)
        np.add.at(step, hit + self.k, -1)
        return np.cumsum(step[:-1]) > 0


def pack(values: np.ndarray) -> bytes:
    """Integers in any order as a byte of width, the least, and fixed-width distances from it."""
    if not len(values):
        return b""
    low = int(values.min())
    far = values.astype(np.uint64) - np.uint64(low & 0xFFFFFFFFFFFFFFFF)  # modulo 2^64, as in unpack
    width = max(1, (int(far.max()).bit_length() + 7) // 8)
    return bytes([width]) + low.to_bytes(8, "little", signed=True) + far.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(blob: bytes) -> np.ndarray:
    """The inverse of pack."""
    if not blob:
        return np.zeros(0, np.int64)
    wide = np.zeros(((len(blob) - 9) // blob[0], 8), np.uint8)
    wide[:, : blob[0]] = np.frombuffer(blob, np.uint8, offset=9).reshape(-1, blob[0])
    return (wide.view("<u8").ravel() + np.uint64(int.from_bytes(blob[1:9], "little"))).view(np.int64)


def _intervals(marks: np.ndarray) -> list[dict[str, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marks.view(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def remove_repeats(docs: DataFrame, window: int = 13, block_bytes: int = 5 << 20, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, intervals (maximal removed runs of words), kept (text; null if not asked for)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = max(2, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    block = F.pmod(F.xxhash64("doc_id"), F.lit(n)).alias("block")
    known, unknown = docs.filter(F.col("doc_id").isNotNull()), docs.filter(F.col("doc_id").isNull())
    blocked = known.select(block, "doc_id", "text")

    shift = np.uint64(64 - (n - 1).bit_length())

    def sketch(table: pa.Table) -> pa.Table:
        """The block's fingerprints with their least ids, a row for each bucket (their first bits) that has some."""
        prints, least = _Block(table, window).firsts()
        bucket = (prints >> shift).astype(np.int64)
        edge = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, np.int64)
        runs = list(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))
        of = int(table.column("block")[0].as_py())
        return pa.table({"bucket": pa.array(bucket[edge[:-1]], pa.int64()), "block": pa.array([of] * len(runs), pa.int64()), "prints": pa.array([pack_sorted(prints[a:z]) for a, z in runs], pa.binary()), "ids": pa.array([pack(least[a:z]) for a, z in runs], pa.binary())})

    def count(table: pa.Table) -> pa.Table:
        """One bucket: of each fingerprint that several blocks have, the blocks whose least id isn't the least of all."""
        blocks, columns = table.column("block").to_numpy(), [table.column(c).to_pylist() for c in ("prints", "ids")]
        parts = [unpack_sorted(x) for x in columns[0]]
        prints, ids = np.concatenate(parts), np.concatenate([unpack(x) for x in columns[1]])
        owner = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
        by = np.argsort(prints, kind="stable")
        prints, ids, owner = prints[by], ids[by], owner[by]
        start = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]]))
        size = np.diff(np.append(start, len(prints)))
        later = np.repeat(np.minimum.reduceat(ids, start), size) < ids
        prints, owner = prints[later], owner[later]
        by = np.argsort(owner, kind="stable")
        prints, owner = prints[by], owner[by]
        edge = np.searchsorted(owner, np.arange(len(parts) + 1))
        some = [i for i in range(len(parts)) if edge[i + 1] > edge[i]]
        return pa.table({"block": pa.array(blocks[some], pa.int64()), "prints": pa.array([pack_sorted(prints[edge[i] : edge[i + 1]]) for i in some], pa.binary())})

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        b = _Block(left, window)
        blobs = right.column("prints").to_pylist() if right.num_rows else []
        marks = b.marked(np.unique(np.concatenate([unpack_sorted(x) for x in blobs])) if blobs else np.zeros(0, np.uint64))
        edge = np.searchsorted(b.rows, np.arange(left.num_rows + 1))
        return _rows(b.ids, b.data, b.offsets, edge, marks, with_text)

    sketched = blocked.groupBy("block").applyInArrow(sketch, "bucket long, block long, prints binary, ids binary")
    # Counting: a block's windows repeat where some other block has their fingerprint in a smaller document.
    found = sketched.groupBy("bucket").applyInArrow(count, "block long, prints binary")
    out = blocked.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(judge, RESULT)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            data, offsets = flat(x.column("text"))
            starts, _, rows = word_spans(data, offsets)
            edge = np.searchsorted(rows, np.arange(x.num_rows + 1))
            yield from _rows(np.zeros(x.num_rows), data, offsets, edge, np.zeros(len(starts), bool), with_text, [None] * x.num_rows).to_batches()

    return out.unionByName(unknown.mapInArrow(whole, RESULT))


def _rows(ids, data: np.ndarray, offsets: np.ndarray, edge: np.ndarray, marks: np.ndarray, with_text: bool, names: list | None = None) -> pa.Table:
    """The result's rows: row i has the words edge[i]:edge[i+1] of the block, of which those marked go."""
    removed, digests, spans, texts = [], [], [], []
    raw = data.tobytes()
    for i in range(len(offsets) - 1):
        words, m = raw[offsets[i] : offsets[i + 1]].split(), marks[edge[i] : edge[i + 1]]
        gone = int(m.sum())
        kept = b" ".join(compress(words, (~m).tolist()) if gone else words)
        removed.append(gone)
        digests.append(hashlib.sha256(kept).hexdigest())
        spans.append(_intervals(m) if gone else [])
        texts.append(kept.decode("utf-8", "replace") if with_text else None)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.table({"doc_id": pa.array(names if names is not None else ids, pa.int64()), "n_words": pa.array(np.diff(edge), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string()), "intervals": pa.array(spans, span), "kept": pa.array(texts, pa.string())})
