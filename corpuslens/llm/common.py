"""Helpers shared by the training-data operators: tables, cut points, word hashing."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import cut, remove, shared_folder  # noqa: F401

# The bytes that separate words, `[\x20\x09-\x0D]`.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

IS_WORD = np.ones(256, dtype=bool)
IS_WORD[list(SEPARATORS)] = False
LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[65:91] += 32

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of the input folder; the path may be in any store that Spark opens."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Return what this process's allocators keep unused to the system, where they can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim is not None:
        trim(0)


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def giving_back(run: Batches) -> Batches:
    """`run` for mapInArrow, its memory returned at the end of each task: Python workers outlive their tasks and stages, and would hold it beside the next ones'."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidy


def crc32_of_id(column: str = "doc_id"):
    """crc32 of the id's decimal text, the basis of the hold-out rules."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the n+1 offsets of its values (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most `limit` bytes each (one row at least)."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (exclusive) and row number of every word; words never cross rows."""
    n = len(data)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, e
    inside = IS_WORD[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, eight bytes at a time."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    length = ends - starts
    h = length.astype(np.uint64) * _GOLDEN
    mask = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
    live, at = np.arange(len(starts)), starts
    while len(live):
        left = length[live] if at is starts else ends[live] - at
        chunk = eight[at] & mask[np.minimum(left, 8)]
        h[live] = mix(h[live] ^ chunk)
        more = left > 8
        live, at = live[more], at[more] + 8
    return h


def windows(h: np.ndarray, rows: np.ndarray, k: int, base: int = 0x5851F42D4C957F2D) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp fingerprints of every run of k words inside one row, and the index of each run's first word."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    b, acc = np.uint64(base), np.zeros(n, np.uint64)
    for j in range(k):
        acc *= b
        acc += h[j : j + n]
    at = np.flatnonzero(rows[:n] == rows[k - 1 :])
    return mix(acc[at]), at


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending uint64 values as fixed-width differences: one byte of width, the first value, then the differences."""
    if not len(values):
        return b""
    step = np.diff(values)
    width = max(1, (int(step.max()).bit_length() + 7) // 8) if len(step) else 1
    body = step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + int(values[0]).to_bytes(8, "little") + body.tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    """The inverse of pack_sorted."""
    if not blob:
        return np.zeros(0, np.uint64)
    width, first = blob[0], int.from_bytes(blob[1:9], "little")
    raw = np.frombuffer(blob, np.uint8, offset=9).reshape(-1, width)
    step = np.zeros((len(raw), 8), np.uint8)
    step[:, :width] = raw
    out = np.empty(len(raw) + 1, np.uint64)
    out[0] = first
    np.cumsum(step.view("<u8").ravel(), out=out[1:])
    out[1:] += np.uint64(first)
    return out
