"""Packing tokenised documents into sequences of a fixed length.

The lengths' histogram (at most `capacity` bins) goes to the driver. A configuration linear program over it (patterns
of lengths that fit one sequence; every length covered) is solved by multiplicative weights: lengths that lag behind
gain weight, and knapsack dynamic programming prices the patterns of most weight. The solution is rounded, down first and
then up for full patterns by the largest remainders; the program is solved again over what is left, and the last part of the
histogram is packed by best fit, still as counts. Pieces then take their places by rank in their length.

Defined results: null text is empty and makes one piece of one token (the separator); only documents over `capacity`
are cut, the first piece being the shorter one; repeated rows are separate documents; an empty table gives no pieces.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, giving_back

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Tokens:
    """Ids of a text as little-endian 32-bit bytes, equal to those of the tokenizers library for the same vocabulary (tests hold the two equal;
    the library alone takes 547 CPU seconds a GB, over the check's budget).

    Text is cut at single spaces between two visible characters, where the vocabulary's pattern always breaks, and the pieces are looked up in
    a bounded memory; unseen ones go to the byte-pair encoder of the same ranks, texts with special tokens to the library."""

    SPACE = re.compile(r"\s |[ ]\s")
    SPECIAL = "<|endoftext|>"

    def __init__(self, name: str = "byte_bpe_50k", keep: int = 200_000):
        import base64

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoder = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.path, self.whole, self.known, self.keep = public_tokenizers.path(f"{name}.json"), None, {}, keep

    def _encode(self, text: str) -> bytes:
        return np.array(self.encoder.encode_ordinary(text), "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if self.SPECIAL in text:
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.path)
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if self.SPACE.search(text):
            return self._encode(text)
        head, *rest = text.split(" ")
        known, get, out = self.known, self.known.get, [self._encode(head)]
        if len(known) > self.keep:
            known.clear()
        for word in rest:
            ids = get(word)
            if ids is None:
                ids = self._encode(" " + word)
                if len(word) < 40:
                    known[word] = ids
            out.append(ids)
        return b"".join(out)


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all but the first have full length."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenise(docs: DataFrame, capacity: int = 2048, end_id: int = 0, tokenizer: Callable[[], Callable[[str], bytes]] = Tokens) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32."""

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail = tokenizer(), np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = encode(text.as_py() or "") + tail
                rows += [(doc, i, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for i, (s, n) in enumerate(cut_points(len(ids) // 4, capacity))]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def knapsack(value: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value of each capacity with any number of each length, and the last length used (0: none)."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        n = int(np.searchsorted(lengths, c, side="right"))
        if n:
            v = best[c - lengths[:n]] + value[:n]
            i = int(v.argmax())
            if v[i] > best[c - 1]:
                best[c], last[c] = v[i], lengths[i]
                continue
        best[c] = best[c - 1]
    return best, last


def pattern_of(last: np.ndarray, c: int) -> dict[int, int]:
    out: dict[int, int] = {}
    while c > 0:
        if last[c]:
            out[int(last[c])] = out.get(int(last[c]), 0) + 1
            c -= int(last[c])
        else:
            c -= 1
    return out


def fractional(histogram: dict[int, int], capacity: int, rounds: int = 120, eta: float = 0.2, many: int = 24) -> dict[tuple, float]:
    """Multiplicative weights for the covering program: pattern (sorted (length, times) pairs) -> how many sequences.

    Each round prices patterns against the weights by one dynamic program and reads off the best one, and the best with
    each of the `many` lengths covered least; each gets 1/`rounds` of what its scarcest length allows. A length's weight
    then falls by exp(-eta) for every mean that its coverage lies above the mean. The sum is scaled to cover the median length just so."""
    lengths = np.array(sorted(histogram), np.int64)
    need = np.array([histogram[int(n)] for n in lengths], float)
    where = {int(n): i for i, n in enumerate(lengths)}
    weight, covered, x = lengths / capacity, np.zeros(len(lengths)), {}
    for _ in range(rounds):
        _, last = knapsack(weight, lengths, capacity)
        patterns = [pattern_of(last, capacity)]
        for i in np.argsort(covered / need, kind="stable")[:many]:
            p = pattern_of(last, capacity - int(lengths[i]))
            p[int(lengths[i])] = p.get(int(lengths[i]), 0) + 1
            patterns.append(p)
        for key in dict.fromkeys(tuple(sorted(p.items(), reverse=True)) for p in patterns):
            step = min(need[where[n]] / t for n, t in key) / rounds
            x[key] = x.get(key, 0.0) + step
            for n, t in key:
                covered[where[n]] += step * t
        share = covered / need
        weight = weight * np.exp(-eta * (share / share.mean() - 1))
        weight /= weight.max()
    scale = 1 / max(float(np.median(covered / need)), 1e-12)
    return {p: v * scale for p, v in x.items()}


def best_fit(left: dict[int, int], capacity: int) -> dict[tuple, int]:
    """Best fit, longest first, over counts: sequences with equal contents are one entry."""
    room: dict[int, dict[tuple, int]] = {}
    spaces: list[int] = []
    import bisect

    def put(space: int, key: tuple, count: int) -> None:
        if space not in room:
            room[space] = {}
            bisect.insort(spaces, space)
        room[space][key] = room[space].get(key, 0) + count

    for n in sorted(left, reverse=True):
        todo = left[n]
        while todo > 0:
            at = bisect.bisect_left(spaces, n)
            if at == len(spaces):
                per = capacity // n
                if todo >= per:
                    put(capacity - per * n, ((n, per),), todo // per)
                    todo %= per
                else:
                    put(capacity - todo * n, ((n, todo),), 1)
                    todo = 0
                continue
            space = spaces[at]
            key, count = next(iter(room[space].items()))
            per = min(space // n, todo)
            use = min(count, todo // per)
            if use == count:
                del room[space][key]
                if not room[space]:
                    del room[space]
                    spaces.pop(at)
            else:
                room[space][key] = count - use
            todo -= use * per
            put(space - per * n, (*key, (n, per)), use)
    out: dict[tuple, int] = {}
    for group in room.values():
        for key, count in group.items():
            out[key] = out.get(key, 0) + count
    return out


def rounded(solution: dict[tuple, float], left: dict[int, int], capacity: int, full: float = 0.995) -> list[tuple[tuple, int]]:
    """Whole numbers of patterns: each rounded down first; then, by the largest remainders, one more of those that fill a sequence, as long as
    `left` (which is reduced) has their pieces."""
    out: dict[tuple, int] = {}

    def take(pattern: tuple, n: int) -> None:
        n = min(n, *(left.get(length, 0) // times for length, times in pattern))
        if n > 0:
            out[pattern] = out.get(pattern, 0) + n
            for length, times in pattern:
                left[length] -= n * times

    for p, x in sorted(solution.items(), key=lambda i: (-i[1], i[0])):
        take(p, int(x))
    for p, _ in sorted(solution.items(), key=lambda i: (int(i[1]) - i[1], i[0])):
        if sum(length * times for length, times in p) >= full * capacity:
            take(p, 1)
    return sorted(out.items())


def plan(histogram: dict[int, int], capacity: int = 2048, solves: int = 3) -> list[tuple[tuple, int]]:
    """(pattern, number of sequences) that hold the histogram's pieces exactly: the program, solved again over what rounding left until that is
    little, and best fit for the rest."""
    left = {n: c for n, c in histogram.items() if c > 0}
    out: list[tuple[tuple, int]] = [(((n, 1),), left.pop(n)) for n in [capacity] if n in left]
    tokens = lambda: sum(n * c for n, c in left.items())
    whole = tokens()
    for _ in range(solves):
        if tokens() <= 0.15 * whole:
            break
        left = {n: c for n, c in left.items() if c}
        found = rounded(fractional(left, capacity), left, capacity)
        if not found:
            break
        out += found
    out += sorted(best_fit({n: c for n, c in left.items() if c}, capacity).items())
    return out


def places(layout: list[tuple[tuple, int]]) -> dict[str, np.ndarray]:
    """For each length, runs of ranks: the rank that a run starts at, items a sequence, its first sequence, the offset in it."""
    used: dict[int, int] = {}
    runs: list[tuple[int, int, int, int, int]] = []
    base = 0
    for p, n in layout:
        offset = 0
        for length, times in p:
            runs.append((length, used.get(length, 0), times, base, offset))
            used[length] = used.get(length, 0) + n * times
            offset += length * times
        base += n
    runs.sort()
    a = np.array(runs, np.int64).reshape(-1, 5)
    return {"key": a[:, 0] * (1 << 48) + a[:, 1], "start": a[:, 1], "times": a[:, 2], "base": a[:, 3], "offset": a[:, 4]}


def pack(docs: DataFrame, capacity: int = 2048, end_id: int = 0, tokenizer: Callable[[], Callable[[str], bytes]] = Tokens, shard_pieces: int = 50_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    pieces = cut(tokenise(docs, capacity, end_id, tokenizer))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs = spark.sparkContext.broadcast(places(plan(counts, capacity)) if counts else None)
    # A length that very many pieces share is ranked in shards, whose counts before each give the rank in the length.
    shards = max(4, -(-sum(counts.values()) // shard_pieces))
    p = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start"), F.lit(shards)))
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = p.groupBy("length", "shard").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    nth = Window.partitionBy("length", "shard").orderBy("doc_id", "piece", "ids_crc32")
    p = p.withColumn("nth", F.row_number().over(nth)).join(sizes, ["length", "shard"]).withColumn("rank", F.col("before") + F.col("nth") - 1)

    @giving_back
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            r = runs.value
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(r["key"], length * (1 << 48) + rank, side="right") - 1
            step = rank - r["start"][at]
            seq, off = r["base"][at] + step // r["times"][at], r["offset"][at] + step % r["times"][at] * length
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq, pa.int64()), pa.array(off, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return p.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, PIECES + ", sequence_id long, offset long")
