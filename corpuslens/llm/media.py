"""Texts as lossless images: a payload of bytes becomes WebP files, which are read back to pixel arrays and described.

A payload is the text's UTF-8 bytes and spaces up to a positive multiple of 192: rows of 192 grey pixels,
opaque. Payloads over `part` bytes (2048 rows) are stored as several files one after another, so memory stays
bounded for texts of any length.

Defined results: null text is stored as the empty text; equal texts give equal values; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import webp

ROW = 192
PART = ROW * 2048


def payload(text: bytes) -> bytes:
    return text + b" " * (max(ROW, -(-len(text) // ROW) * ROW) - len(text))


def store(data: bytes) -> bytes:
    """The payload as lossless WebP files, one for each PART bytes."""
    parts = (np.frombuffer(data, np.uint8, min(PART, len(data) - a), a).reshape(-1, ROW) for a in range(0, len(data), PART))
    return b"".join(map(webp.encode_gray, parts))


def load(media: bytes) -> np.ndarray:
    """The samples [rows, 192] of all files in `media` (red, green and blue are the same)."""
    out, at = [], 0
    while at < len(media):
        size = 8 + struct.unpack_from("<I", media, at + 4)[0]
        out.append(webp.decode(media[at : at + size])[..., 2])
        at += size
    return np.ascontiguousarray(out[0] if len(out) == 1 else np.concatenate(out))


def feature(samples: np.ndarray) -> str:
    """Size, mean in hundredths, and a 64-bit average hash over an 8 x 8 grid."""
    h = len(samples)
    columns = samples.reshape(h, 8, ROW // 8).sum(2, dtype=np.int64)
    edge = np.arange(9) * h // 8
    upto = np.concatenate([np.zeros((1, 8), np.int64), np.cumsum(columns, 0)])
    low, high = edge[:-1], np.maximum(edge[1:], edge[:-1] + 1)
    grid = (upto[high] - upto[low]) / (high - low)[:, None]
    bits = np.packbits(grid > grid.mean()).tobytes()
    return f"{h}x{ROW};{int(upto[-1].sum()) * 100 // samples.size};{bits.hex()}"


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary"


def as_media(docs: DataFrame, with_media: bool = True) -> DataFrame:
    """One row a document: what was stored (`media`, null if not asked for), and digests and features of what was read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column("text"):
                text = (t.as_py() or "").encode("utf-8", "replace")
                media = store(payload(text))
                samples = load(media)
                back = samples.tobytes()
                rows.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples), media if with_media else None))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
