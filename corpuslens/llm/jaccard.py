"""Exact Jaccard self-join of word-shingle sets by partitioning the universe.

Two sets of sizes r and s link at 9/10 only if they differ in at most (r + s) / 19 shingles. Sizes fall into bands a
ninth wide, so a pair lies in one band or in two neighbours; each band has a scheme, and a set takes part in its own
band's and the next lower one's. A scheme hashes the universe into segments and allots each a number: 0 (skipped), 1
(its part of a set must be equal) or 2 (equal up to one shingle: the part and its one-deletion neighbourhood are
indexed). As the numbers sum to more than the pair may differ by, some segment of every linking pair matches. Which
segments get 0 or 2 is decided by what they cost: rows to index, and pairs that collide, counted over all sets on a
1/512 slice of the signature space.

A bucket of equal signatures holds candidates. Each set also has a parity sketch of 512 bits; two sketches never differ
in more bits than their sets do in shingles, so pairs whose sketches differ too much are left out without any loss. Of
the rest each node is first tested with the one near node that has most near nodes itself (in a group of copies, the
likely original); then the best connected nodes of the components of a bucket meet; last, whatever lies outside a
bucket's largest component is tested with all that is near to it and not yet connected. So no link between components is lost, and
groups of thousands don't cost thousands squared. Buckets over BLOCK rows are cut into blocks that meet in cells.
Candidates are verified on the sets themselves.

Shingles, signatures and nodes are 63/64-bit hashes (chance collisions: n^2 / 2^64 for n distinct sets).

Defined results: null text or text without words has an empty set, size 0, and is its own component; one or two words
are one shingle; rows of equal text or equal doc_id are in the component of their set; where no row of a component has
a doc_id, component_id is null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER_ASCII, WORD_PATTERN, cut, flat, giving_back, mix, remove, slices, windows, word_hashes, word_spans

PERCENT = 90  # a pair links when 100 * common >= percent * union
TABLE = 1 << 16  # sets of up to so many shingles have allotments of their own
SLICE = 512  # the share of the signature space that costs are counted on
OFTEN = 32  # shingles in more prefixes than this come last in their sets' order
MOST = 100_000  # of them, so many travel to the tasks
SKETCH = 512  # bits
BLOCK = 2048  # rows of a bucket that one step compares with each other
PAIRS = 1 << 22  # of rows that one step holds, near ones at most, beside the pairs of one block
FEW = 500_000  # so many rows of pairs to test (of some 30 bytes) are broadcast, more are joined by shuffles
ONE_TASK = 200_000  # so many links (of 16 bytes) are connected in one task, more by rounds of shuffles
LINKS = 1 << 20  # that a task connects at once before them; not under ONE_TASK


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and the n+1 offsets of the texts' sets."""
    n = len(offsets) - 1
    lower = LOWER_ASCII[data]
    starts, ends, rows = word_spans(lower, offsets)
    h = word_hashes(lower, starts, ends)
    prints, at = windows(h, rows, k)
    owner = rows[at]
    words = np.bincount(rows, minlength=n) if len(rows) else np.zeros(n, np.int64)
    first = np.searchsorted(rows, np.arange(n))
    for short in range(1, k):
        r = np.flatnonzero(words == short)
        if len(r):
            acc = np.full(len(r), short, np.uint64)
            for j in range(short):
                acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[first[r] + j])
            prints, owner = np.concatenate([prints, acc]), np.concatenate([owner, r])
    order = np.lexsort((prints, owner))
    prints, owner = prints[order], owner[order]
    if len(prints):
        new = np.ones(len(prints), bool)
        new[1:] = (prints[1:] != prints[:-1]) | (owner[1:] != owner[:-1])
        prints, owner = prints[new], owner[new]
    return prints, np.searchsorted(owner, np.arange(n + 1))


def node_of(part: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(part.tobytes()) >> 1


class Schemes:
    """Size bands, their segments, and what each segment is allotted.

    Only the bands of sets up to `table` shingles have allotments of their own, so the plan's size doesn't follow the
    longest text; larger sets' bands have one segment more than their sets may differ by, each with one."""

    def __init__(self, percent: int = PERCENT, table: int = TABLE):
        self.least = -(-percent // (100 - percent))  # smaller sets can't link to different ones
        lows, highs, at = [], [], self.least
        while at < 1 << 40:
            lows.append(at)
            highs.append(at * 100 // percent)
            at = highs[-1] + 1
        self.low, self.high = np.array(lows), np.array(highs)
        self.differ = (self.high + self.high * 100 // percent) * (100 - percent) // (100 + percent)
        self.planned = int(np.searchsorted(self.low, table, side="right"))
        spare = np.maximum(1, (self.differ + 1) // 10)
        spare[self.planned :] = 0
        self.segments = self.differ + 1 + spare
        self.offset = np.concatenate([[0], np.cumsum(self.segments)])
        self.allotted = np.ones(self.offset[self.planned], np.int8)

    def allot(self, ones: np.ndarray, twos: np.ndarray) -> None:
        """Least cost: start from nothing and take the cheapest next step of any segment until the sum is reached."""
        for b in range(self.planned):
            a, z = self.offset[b], self.offset[b + 1]
            first, second = ones[a:z], np.maximum(twos[a:z] - ones[a:z], ones[a:z])
            need = int(self.differ[b]) + 1
            steps = np.concatenate([first, second])
            kind = np.concatenate([np.arange(z - a), np.arange(z - a)])
            chosen = np.argsort(steps, kind="stable")[:need]
            # A second step is never cheaper than its own first, and comes after it where equal.
            self.allotted[a:z] = np.bincount(kind[chosen], minlength=z - a)

    def signatures(self, prints: np.ndarray, edges: np.ndarray, every: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, place of the segment among all, kind, signature): kind 1 for whole parts, 2 for parts of segments allotted two and
        their one-deletions. `every` allots that to all planned segments, and leaves the others out."""
        sizes = np.diff(edges)
        own = np.searchsorted(self.high, sizes)
        out: list[tuple[np.ndarray, ...]] = []
        value = mix(prints + np.uint64(0x632BE59BD9B4E019))
        row_of = np.repeat(np.arange(len(sizes)), sizes)
        for lower in (0, 1):
            band = own - lower
            live = (sizes >= self.least) & (band >= 0)
            if every is not None:
                live &= band < self.planned
            if not live.any():
                continue
            rows = np.flatnonzero(live)
            m, base = self.segments[band[rows]], np.zeros(len(sizes), np.int64)
            ends = np.cumsum(m)
            base[rows] = ends - m
            inside = live[row_of]
            p, v, r = (prints, value, row_of) if inside.all() else (prints[inside], value[inside], row_of[inside])
            at = base[r] + (p % self.segments[band[r]].astype(np.uint64)).astype(np.int64)
            sums = np.zeros(int(ends[-1]), np.uint64)
            np.add.at(sums, at, v)
            owner = np.repeat(rows, m)
            place = self.offset[band[owner]] + np.arange(len(owner)) - base[owner]
            salt = mix(place.astype(np.uint64) + np.uint64(0x1234567))
            share = np.ones(len(place), np.int8)
            if every is not None:
                share[:] = every
            else:
                planned = place < len(self.allotted)
                share[planned] = self.allotted[place[planned]]
            one = share == 1
            out.append((owner[one], place[one], np.ones(int(one.sum()), np.int8), mix(sums[one] ^ salt[one])))
            two = share == 2
            if two.any():
                out.append((owner[two], place[two], np.full(int(two.sum()), 2, np.int8), mix(sums[two] + salt[two])))
                e = two[at]
                out.append((r[e], place[at[e]], np.full(int(e.sum()), 2, np.int8), mix(sums[at[e]] - v[e] + salt[at[e]])))
        if not out:
            z = np.zeros(0, np.int64)
            return z, z, z.astype(np.int8), z.astype(np.uint64)
        return tuple(np.concatenate([o[i] for o in out]) for i in range(4))


class Prefixes:
    """For lower thresholds, where segments would hold so few shingles that many are empty: two sets that link at percent share one of
    the first n - ceil(percent * n / 100) + 1 shingles of each, in any order common to all sets. Shingles met often come last, the commonest at the end."""

    def __init__(self, percent: int):
        self.percent, self.least = percent, -(-percent // (100 - percent))
        self.often, self.times = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def put_last(self, sigs: np.ndarray, times: np.ndarray) -> None:
        order = np.argsort(sigs)
        self.often, self.times = sigs[order], times[order]

    def signatures(self, prints: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As those of Schemes; the place is that in the set's order."""
        sizes = np.diff(edges)
        row = np.repeat(np.arange(len(sizes)), sizes)
        sig = mix(prints + np.uint64(0x632BE59BD9B4E019))
        times = np.zeros(len(sig), np.int64)
        if len(self.often):
            at = np.minimum(np.searchsorted(self.often, sig), len(self.often) - 1)
            times = np.where(self.often[at] == sig, self.times[at], 0)
        order = np.lexsort((sig, times, row))
        row, sig = row[order], sig[order]
        place = np.arange(len(sig)) - np.repeat(edges[:-1] - edges[0], sizes)
        length = np.where(sizes >= self.least, sizes + sizes * -self.percent // 100 + 1, 0)
        first = place < length[row]
        return row[first], place[first], np.ones(int(first.sum()), np.int8), sig[first]


# ── Parity sketches ──


def sketches(prints: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """[sets, SKETCH / 64] words: bit h is the parity of the number of shingles that fall on h. A shingle that only one of two
    sets holds flips one bit, so two sketches differ in no more bits than the sets do in shingles."""
    n = len(edges) - 1
    out = np.zeros((n, SKETCH // 64), np.uint64)
    bit = (mix(prints ^ np.uint64(0x1F83D9ABFB41BD6B)) % np.uint64(SKETCH)).astype(np.int64)
    for a in range(0, n, 20_000):
        z = min(n, a + 20_000)
        size = np.diff(edges[a : z + 1])
        flips = np.zeros((z - a) * SKETCH, np.uint8)
        np.add.at(flips, np.repeat(np.arange(z - a) * SKETCH, size) + bit[edges[a] : edges[z]], np.uint8(1))
        out[a:z] = np.packbits((flips & 1).reshape(z - a, SKETCH), axis=1).view(np.uint64)
    return out


def wide_sketches(prints: np.ndarray, edges: np.ndarray) -> list[bytes | None]:
    """Of each set over SKETCH shingles the same parities by as many bits as the next power of two, which holds the set's size: the short sketch of a
    long set is full, and leaves out nothing. Folded to fewer bits by exclusive or it is the sketch of so many bits. None for other sets."""
    size = np.diff(edges)
    long = size > SKETCH
    out: list[bytes | None] = [None] * len(size)
    if not long.any():
        return out
    bits = np.left_shift(1, np.ceil(np.log2(size[long])).astype(np.int64))
    ends = np.cumsum(bits)
    inside = np.repeat(long, size)
    bit = mix(prints[edges[0] : edges[-1]][inside] ^ np.uint64(0x1F83D9ABFB41BD6B)) & np.repeat(bits - 1, size[long]).astype(np.uint64)
    flips = np.zeros(int(ends[-1]), np.uint8)
    np.add.at(flips, np.repeat(ends - bits, size[long]) + bit.astype(np.int64), np.uint8(1))
    packed = np.packbits(flips & 1)
    for i, a, z in zip(np.flatnonzero(long).tolist(), ((ends - bits) // 8).tolist(), (ends // 8).tolist(), strict=True):
        out[i] = packed[a:z].tobytes()
    return out


def apart(x: bytes, y: bytes) -> int:
    """In how many bits two wide sketches differ, the longer one folded to the length of the other: never more than their sets differ in shingles."""
    u, v = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    v = np.bitwise_xor.reduce(v.reshape(-1, len(u)), axis=0)
    return int(np.bitwise_count(u.view(np.uint64) ^ v.view(np.uint64)).sum(dtype=np.int64))


def screen(percent: int):
    """(a, b, far) of pairs with the sizes and wide sketches of their ends: far if these show that the two can't link."""

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = np.zeros(batch.num_rows, bool)
            na, nb, wa, wb = (batch.column(c) for c in ("na", "nb", "wa", "wb"))
            for i in np.flatnonzero(wa.is_valid().to_numpy(False) & wb.is_valid().to_numpy(False)).tolist():
                far[i] = apart(wa[i].as_py(), wb[i].as_py()) * (100 + percent) > (na[i].as_py() + nb[i].as_py()) * (100 - percent)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(far)], ["a", "b", "far"])

    return run


def near(i: np.ndarray, j: np.ndarray, n: np.ndarray, sketch: np.ndarray, root: np.ndarray, percent: int) -> np.ndarray:
    """Whether rows i and j (broadcast against each other) are of different roots and can link by their sizes and sketches."""
    r, s = n[i], n[j]
    ok = (root[i] != root[j]) & (100 * np.minimum(r, s) >= percent * np.maximum(r, s))
    apart = np.bitwise_count(sketch[i] ^ sketch[j]).sum(-1, dtype=np.int64)
    return ok & (apart * (100 + percent) <= (r + s) * (100 - percent))


def near_strips(start: np.ndarray, n: np.ndarray, sketch: np.ndarray, root: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows i < j of one group (rows start[g] to start[g + 1]) that near() accepts, some at a time: by their distance in small groups, in strips in large ones."""
    size = np.diff(start)
    end = np.repeat(start[1:], size)
    small = np.flatnonzero(np.repeat(size <= 64, size))
    lag = 1
    while len(small := small[end[small] - small > lag]):
        for a in range(0, len(small), 1 << 17):
            i = small[a : a + (1 << 17)]
            i = i[near(i, i + lag, n, sketch, root, percent)].astype(np.int32)
            yield i, i + np.int32(lag)
        lag += 1
    for g in np.flatnonzero(size > 64):
        here = np.arange(start[g], start[g + 1], dtype=np.int32)
        for a in range(0, len(here), 256):
            rest = here[a:]
            x, y = np.nonzero(near(rest[:256, None], rest[None, :], n, sketch, root, percent))
            up = y > x
            yield rest[x[up]], rest[y[up]]


def near_pairs(start: np.ndarray, n: np.ndarray, sketch: np.ndarray, root: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All of near_strips() in one."""
    found = [(np.zeros(0, np.int32), np.zeros(0, np.int32)), *near_strips(start, n, sketch, root, percent)]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def portions(start: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of groups with at most `most` pairs of rows (one group at least): where all rows are near, a table of many large groups has too many to hold."""
    pairs = np.cumsum(np.diff(start) ** 2 // 2)
    g, before = 0, 0
    while g < len(pairs):
        z = max(g + 1, int(np.searchsorted(pairs, before + most, side="right")))
        yield g, z
        g, before = z, int(pairs[z - 1])


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int, least: int = 1 << 15) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The rows of sorted batches again, as tables that end where a group (the first `keys` columns) does, and the n + 1 edges of their groups."""
    held: list[pa.RecordBatch] = []
    rows, enough = 0, least

    def edges(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for c in range(keys):
            v = t.column(c).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.append(np.flatnonzero(new), t.num_rows)

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows >= enough:
            t = pa.Table.from_batches(held).combine_chunks()
            e = edges(t)
            if len(e) > 2:
                yield t.slice(0, e[-2]), e[:-1]
            held = t.slice(e[-2]).to_batches()
            rows = t.num_rows - int(e[-2])
            enough = max(least, 2 * rows)
    if rows:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, edges(t)


def _columns(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """node, n, root and sketch of a table's rows."""
    data, _ = flat(t.column("sketch"))
    return t.column("node").to_numpy(), t.column("n").to_numpy().astype(np.int64), t.column("root").to_numpy(), data.view(np.uint64).reshape(t.num_rows, -1)


def hubs(percent: int):
    """Of each row with near rows in its group, the one of them that has the most near rows itself: in a group of copies, the likely original."""

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, start in whole_groups(batches, 2):
            node, n, root, sketch = _columns(t)
            sig = t.column("sig").to_numpy()
            for g, z in portions(start, PAIRS):
                a, rows = start[g], slice(start[g], start[z])
                here = node[rows]
                i, j = near_pairs(start[g : z + 1] - a, n[rows], sketch[rows], root[rows], percent)
                degree = np.bincount(i, minlength=len(here)) + np.bincount(j, minlength=len(here))
                order = np.lexsort((here, -degree))
                rank, first = np.empty(len(here), np.int64), np.full(len(here), len(here))
                rank[order] = np.arange(len(here))
                np.minimum.at(first, i, rank[j])
                np.minimum.at(first, j, rank[i])
                x = np.flatnonzero(first < len(here))
                y = order[first[x]]
                yield pa.RecordBatch.from_arrays([pa.array(sig[rows][x]), pa.array(here[x]), pa.array(here[y]), pa.array(degree[y])], ["sig", "node", "partner", "degree"])

    return run


def crossing(percent: int):
    """All near pairs of a cell with a row outside the bucket's largest component. Rows of a bucket cut into blocks have a side, and only pairs across sides count."""

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def distinct(pairs: list[np.ndarray]) -> pa.RecordBatch:
            both = np.unique(np.concatenate(pairs), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

        for t, start in whole_groups(batches, 3):
            node, n, root, sketch = _columns(t)
            side, minor = t.column("side").to_numpy(), t.column("minor").to_numpy()
            held, rows = [np.zeros((0, 2), np.int64)], 0
            for i, j in near_strips(start, n, sketch, root, percent):
                ok = (minor[i] | minor[j]) & ((side[i] == 0) | (side[i] != side[j]))
                i, j = node[i[ok]], node[j[ok]]
                held.append(np.stack([np.maximum(i, j), np.minimum(i, j)], 1))
                rows += len(i)
                if rows >= PAIRS // 4:
                    yield distinct(held)
                    held, rows = held[:1], 0
            yield distinct(held)

    return run


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray, list[int]]]:
    """Slices of the batches with their shingle sets: (batch, from, to, shingles, offsets, nodes)."""
    for b in batches:
        data, offsets = flat(b.column("text"))
        for a, z in slices(offsets, 3 << 20):
            prints, edges = shingle_sets(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a], k)
            yield b, a, z, prints, edges, [node_of(prints[edges[i] : edges[i + 1]]) for i in range(z - a)]


def connected(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the links, and the least node that each is connected with."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(node))
    while len(x):
        u, v = root[x], root[y]
        apart = u != v
        x, y, u, v = x[apart], y[apart], u[apart], v[apart]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (root[root] != root).any():
            root = root[root]
    return node, node[root]


def forest(every: bool):
    """A task's links as those of each node to the least one it is connected with there; with `every`, least nodes have one to themselves."""

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            a, b = connected(*(np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("a", "b")))
            keep = np.ones(len(a), bool) if every else a != b
            return pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

        held, rows = [], 0
        for x in batches:
            held.append(x)
            rows += x.num_rows
            if rows >= LINKS:
                yield joined(held)
                held, rows = [], 0
        if rows:
            yield joined(held)

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b). Each task connects its own links first. What is left is connected in one task if it is
    little, as each round of shuffles costs the driver dozens of stages; else by large star and small star in turn until nothing moves."""
    spark, old, new = edges.sparkSession, [], []
    e = cut(edges.select("a", "b").mapInArrow(forest(False), "a long, b long"), old)
    if e.count() <= ONE_TASK:
        roots = cut(e.coalesce(1).mapInArrow(forest(True), "a long, b long"))
        remove(spark, old)
        return roots.toDF("node", "root")

    def both(e: DataFrame) -> DataFrame:
        return e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def stars(e: DataFrame, large: bool) -> DataFrame:
        e = both(e) if large else e
        least = e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m"))
        j = e.join(least, e["a"] == least["c"])
        if large:  # a's larger neighbours go to its least one
            return j.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        # a (the larger end of its links) and its neighbours go to the least of them
        return j.filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("c").alias("a"), F.col("m").alias("b")))

    def down(e: DataFrame) -> DataFrame:
        return e.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    e = cut(down(e), new)
    remove(spark, old)
    old, new = new, old
    while True:
        # Done when every node has one parent and no parent has one itself.
        parents = e.groupBy("a").agg(F.count("*").alias("n"), F.lit(1).alias("up")).unionByName(e.select(F.col("b").alias("a"), F.lit(0).cast("long").alias("n"), F.lit(2).alias("up")).distinct())
        if parents.groupBy("a").agg(F.sum("n").alias("n"), F.sum("up").alias("up")).filter("n > 1 or up = 3").isEmpty():
            break
        e = cut(down(stars(down(stars(e, True)), False)), new)
        remove(spark, old)
        old, new = new, old
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


SLIM = "doc_id long, key long, n_shingles long, node long, sketch binary, wide binary"


def _described(docs: DataFrame, k: int, extra: Callable[[np.ndarray, np.ndarray], pa.Array], kind: str, paths: list[str]) -> DataFrame:
    """(doc_id, key, n_shingles, node, sketch, wide, extra) of every row, in one pass over the texts."""

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, a, z, prints, edges, nodes in _sets(batches, k):
            sketch = sketches(prints, edges).view(np.uint8).reshape(z - a, -1)
            binary = pa.array([row.tobytes() for row in sketch], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(a, z - a), b.column("key").slice(a, z - a), pa.array(np.diff(edges), pa.int64()), pa.array(nodes, pa.int64()), binary, pa.array(wide_sketches(prints, edges), pa.binary()), extra(prints, edges)], ["doc_id", "key", "n_shingles", "node", "sketch", "wide", "extra"])

    return cut(docs.mapInArrow(run, f"{SLIM}, extra {kind}"), paths)


def _lists(row: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    """Values grouped into one list a row; `row` ascending."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32()), values)


def _segments(docs: DataFrame, k: int, percent: int, paths: list[str]) -> tuple[DataFrame, Schemes]:
    """The described rows, and the schemes with their allotment."""
    every = Schemes(percent)
    shape = docs.sparkSession.sparkContext.broadcast(every)

    def probes(prints: np.ndarray, edges: np.ndarray) -> pa.Array:
        got = [shape.value.signatures(prints, edges, kind) for kind in (1, 2)]
        row, place, kind, sig = (np.concatenate([g[i] for g in got]) for i in range(4))
        pick = np.flatnonzero(sig % np.uint64(SLICE) == 0)
        pick = pick[np.argsort(row[pick], kind="stable")]
        values = pa.StructArray.from_arrays([pa.array(place[pick], pa.int64()), pa.array(kind[pick], pa.int32()), pa.array(sig[pick].view(np.int64))], ["place", "kind", "sig"])
        return _lists(row[pick], len(edges) - 1, values)

    slim = _described(docs, k, probes, "array<struct<place:long,kind:int,sig:long>>", paths)
    # What each segment costs: rows to index, and pairs that meet.
    met = slim.select("node", F.explode("extra").alias("p")).select("node", "p.*").distinct().groupBy("place", "kind", "sig").agg(F.count("*").cast("double").alias("f"))
    costs = np.zeros((3, len(every.allotted)))
    # At most two rows a planned segment.
    for r in met.groupBy("place", "kind").agg(F.sum(F.col("f") + 2 * F.col("f") * (F.col("f") - 1)).alias("cost")).collect():
        costs[r["kind"], r["place"]] = r["cost"]
    every.allot(costs[1], costs[2])
    return slim, every


def _prefixes(docs: DataFrame, k: int, percent: int, paths: list[str]) -> tuple[DataFrame, Prefixes]:
    """The described rows, and the order with the shingles that more than OFTEN sets have in their hash-ordered prefix last."""
    order = Prefixes(percent)

    def prefix(prints: np.ndarray, edges: np.ndarray) -> pa.Array:
        row, _, _, sig = order.signatures(prints, edges)
        return _lists(row, len(edges) - 1, pa.array(sig.view(np.int64)))

    slim = _described(docs, k, prefix, "array<long>", paths)
    met = slim.select(F.explode("extra").alias("sig")).groupBy("sig").agg(F.count("*").alias("f")).filter(F.col("f") > OFTEN)
    met = met.orderBy(F.col("f").desc(), "sig").limit(MOST).collect()
    last = Prefixes(percent)
    last.put_last(np.array([r["sig"] for r in met], np.int64).view(np.uint64), np.array([r["f"] for r in met], np.int64))
    return slim, last


def _buckets(docs: DataFrame, k: int, order: Schemes | Prefixes, paths: list[str]) -> DataFrame:
    """(sig, node) of the signatures that several nodes have."""
    shape = docs.sparkSession.sparkContext.broadcast(order)

    @giving_back
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schemes, seen = shape.value, set()
        for number, (_, _, _, prints, edges, nodes) in enumerate(_sets(batches, k)):
            row, _, _, sig = schemes.signatures(prints, edges)
            # A set's signatures leave a task once.
            fresh = np.zeros(len(nodes), bool)
            for i, x in enumerate(nodes):
                if x not in seen:
                    seen.add(x)
                    fresh[i] = True
            keep = fresh[row]
            sig, node = sig[keep].view(np.int64), np.array(nodes, np.int64)[row[keep]]
            by = np.lexsort((node, sig))
            sig, node = sig[by], node[by]
            start = np.ones(len(sig), bool)
            start[1:] = sig[1:] != sig[:-1]
            group = np.cumsum(start) - 1
            often = np.bincount(group)[group] > 8 if len(sig) else np.zeros(0, bool)
            # Signatures met often in one task are dealt out again; their least nodes meet in the plain bucket.
            salt = np.where(often, 1 + (number * 7919 + (int(node[0]) if len(node) else 0)) % 4096, 0)
            lead = often & start
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([sig, sig[lead]])), pa.array(np.concatenate([node, node[lead]])), pa.array(np.concatenate([salt, np.zeros(int(lead.sum()), np.int64)]).astype(np.int32))], ["sig", "node", "salt"])

    rows = docs.mapInArrow(index, "sig long, node long, salt int")
    bucket = Window.partitionBy("sig", "salt").orderBy("node")
    whole = bucket.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("_least", F.first("node").over(bucket)).withColumn("_most", F.last("node").over(whole)).withColumn("_before", F.lag("node").over(bucket))
    rows = rows.filter((F.col("_least") != F.col("_most")) & (F.col("_before").isNull() | (F.col("_before") != F.col("node"))))
    return cut(rows.select("sig", "node").distinct(), paths)


def link_nodes(docs: DataFrame, k: int = 3, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, n_shingles, node) of every row, and (node, root) of the nodes that verified links connect. `key` is a hash of the text."""
    spark = docs.sparkSession
    temporary: list[str] = []
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    described: list[str] = []
    slim, order = _segments(docs, k, percent, described) if percent >= PERCENT else _prefixes(docs, k, percent, described)
    slim = cut(slim.drop("extra"))
    remove(spark, described)
    buckets = _buckets(docs, k, order, temporary)
    # Nodes that share a signature with others: their sizes and sketches.
    about = slim.join(buckets.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("n_shingles").cast("int").alias("n"), F.first("sketch").alias("sketch"), F.first("wide").alias("wide"))
    about = cut(about, temporary)
    long = about.filter("wide is not null").select("node", "n", "wide")
    # Few signatures are shared by more rows than fit a block.
    hot = cut(buckets.groupBy("sig").agg(F.count("*").alias("m")).filter(F.col("m") > BLOCK), temporary)

    def cells(rows: DataFrame, by: list[str]) -> DataFrame:
        """Rows with sizes and sketches, each group together and in order."""
        full = rows.join(about.drop("wide"), "node")
        return full.select(*by, "node", "n", "root", "sketch", *[c for c in rows.columns if c not in (*by, "node", "root")]).repartition(*by).sortWithinPartitions(*by, "node")

    def blocks(m: Column) -> Column:
        return F.greatest(F.lit(1), F.ceil(m / BLOCK)).cast("int")

    def block_of(n: Column, seed: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), "node"), n).cast("int")

    # In each block, every node is paired with its hub; over all its blocks it is tested with the best of these only.
    dealt = buckets.join(hot, "sig", "left").withColumn("block", block_of(blocks(F.coalesce("m", F.lit(1))), 0)).select("sig", "block", "node", F.col("node").alias("root"))
    offered = cut(cells(dealt, ["sig", "block"]).mapInArrow(hubs(percent), "sig long, node long, partner long, degree long"), temporary)
    # From here on only rows count that some other row of their bucket is near to, and those of buckets that were cut into blocks.
    live = offered.select("sig", "node").unionByName(buckets.join(hot, "sig", "left_semi").select("sig", "node")).distinct()
    live = cut(live, temporary)
    names = live.select("node").distinct()
    # One row's text stands for each node: that of its least doc_id; rows without ids are all looked at.
    stand = slim.filter(F.col("doc_id").isNotNull()).groupBy("node").agg(F.min(F.struct("doc_id", "key")).alias("s")).join(names, "node", "left_semi").select("node", "s.*")
    stand = cut(stand, temporary)
    unknown = docs.filter("doc_id is null")

    @giving_back
    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, _, _, prints, edges, nodes in _sets(batches, k):
            new = [i for i, x in enumerate(nodes) if x not in seen and not seen.add(x)]
            parts = [prints[edges[i] : edges[i + 1]].astype("<u8").tobytes() for i in new]
            yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in new], pa.int64()), pa.array(parts, pa.binary())], ["node", "parts"])

    @giving_back
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, start in whole_groups(batches, 2, 1):
            found: list[tuple[int, int, bool]] = []
            hub, node, parts = t.column("hub").to_pylist(), t.column("node").to_pylist(), t.column("parts")
            for g, z in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
                of = {node[i]: i for i in range(g, z)}
                x = np.frombuffer(parts[of[hub[g]]].as_buffer(), "<u8")
                for other, i in of.items():
                    if other != hub[g]:
                        v = np.concatenate([x, np.frombuffer(parts[i].as_buffer(), "<u8")])
                        v.sort(kind="stable")
                        common = int((v[1:] == v[:-1]).sum())
                        found.append((max(other, hub[g]), min(other, hub[g]), 100 * common >= percent * (len(v) - common)))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.bool_()))], ["a", "b", "ok"])

    def tested(pairs: DataFrame) -> DataFrame:
        """(a, b, ok) of the pairs. Each pair's end with more pairs is its hub; at most some 64 others meet a hub's set in one group, so a set travels
        once for each of its pairs where it isn't the hub, and once for 64 where it is. No set of a node outside the pairs is made, and none of pairs
        of long sets whose wide sketches, a thirtieth of the sets or less, already differ too much: these would be most of the bytes."""
        both = pairs.join(long.toDF("a", "na", "wa"), "a", "left").join(long.toDF("b", "nb", "wb"), "b", "left")
        screened = cut(both.select("a", "b", "na", "nb", "wa", "wb").mapInArrow(screen(percent), "a long, b long, far boolean"), temporary)
        p = screened.filter("not far").select("a", "b")
        degree = p.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
        p = p.join(degree.toDF("a", "da"), "a").join(degree.toDF("b", "db"), "b")
        first = (F.col("da") > F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
        p = p.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("node"), F.ceil(F.greatest("da", "db") / 64).cast("int").alias("n"))
        p = p.select("hub", F.pmod(F.xxhash64("node"), F.col("n")).cast("int").alias("part"), "node")
        roles = cut(p.unionByName(p.select("hub", "part", F.col("hub").alias("node")).distinct()), temporary)
        wanted = stand.join(roles.select("node").distinct(), "node", "left_semi").select("doc_id", "key")
        if roles.count() <= FEW:
            roles, wanted = F.broadcast(roles), F.broadcast(wanted)
        texts = docs.filter("doc_id is not null").join(wanted, ["doc_id", "key"], "left_semi").unionByName(unknown)
        met = texts.select("text").mapInArrow(members, "node long, parts binary").join(roles, "node").select("hub", "part", "node", "parts")
        met = met.repartition("hub", "part").sortWithinPartitions("hub", "part")
        met = cut(met.mapInArrow(verify, "a long, b long, ok boolean"), temporary)
        return met.unionByName(screened.filter("far").select("a", "b", F.lit(False).alias("ok")))

    def best(offers: DataFrame) -> DataFrame:
        chosen = offers.groupBy("node").agg(F.max(F.struct("degree", (-F.col("partner")).alias("p"))).alias("c")).select("node", (-F.col("c.p")).alias("partner"))
        return chosen.select(F.greatest("node", "partner").alias("a"), F.least("node", "partner").alias("b")).distinct()

    def rooted(roots: DataFrame) -> DataFrame:
        """Live rows of buckets whose nodes are not all connected: (sig, node, root, n_roots, m, major)."""
        m = live.join(roots, "node", "left").select("sig", "node", F.coalesce("root", "node").alias("root"))
        per = m.groupBy("sig", "root").agg(F.count("*").alias("c")).groupBy("sig").agg(F.count("*").alias("n_roots"), F.sum("c").alias("m"), F.max(F.struct("c", "root")).alias("t"))
        return m.join(per.filter("n_roots > 1").select("sig", "n_roots", "m", F.col("t.root").alias("major"), F.col("t.c").alias("in_major")), "sig")

    done = tested(best(offered))
    roots = components(done.filter("ok"))
    rest = cut(rooted(roots), temporary)
    for turn in range(1, 4):
        if rest.isEmpty():
            break
        # The best connected node of each component in a bucket stands for it, and meets the other components' ones.
        often = done.filter("ok").select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
        heads = rest.join(often, "node", "left").groupBy("sig", "root").agg(F.max(F.struct(F.coalesce("links", F.lit(0)).alias("l"), F.xxhash64(F.lit(turn), "node").alias("h"), "node")).alias("t"), F.first("n_roots").alias("n_roots"))
        heads = heads.select("sig", "root", F.col("t.node").alias("node"), "n_roots")
        heads = heads.withColumn("block", block_of(blocks(F.col("n_roots")), turn)).drop("n_roots")
        more = cells(heads, ["sig", "block"]).mapInArrow(hubs(percent), "sig long, node long, partner long, degree long")
        new = tested(best(more).join(done.select("a", "b"), ["a", "b"], "left_anti"))
        done = done.unionByName(new)
        if new.filter("ok").isEmpty():
            break
        roots = components(done.filter("ok"))
        rest = cut(rooted(roots), temporary)
    # What may still link: rows outside the largest component of their bucket, against all the bucket's rows.
    if not rest.isEmpty():
        rest = rest.withColumn("minor", F.col("root") != F.col("major"))
        rest = rest.withColumn("xs", blocks(F.col("m") - F.col("in_major"))).withColumn("ys", blocks(F.col("m")))
        one = rest.filter(F.col("m") <= BLOCK).select("sig", F.lit(0).alias("xb"), F.lit(0).alias("yb"), "node", "root", "minor", F.lit(0).alias("side"))
        many = rest.filter(F.col("m") > BLOCK)
        x = many.filter("minor").select("sig", block_of(F.col("xs"), 8).alias("xb"), F.explode(F.sequence(F.lit(0), F.col("ys") - 1)).alias("yb"), "node", "root", "minor", F.lit(1).alias("side"))
        y = many.select("sig", F.explode(F.sequence(F.lit(0), F.col("xs") - 1)).alias("xb"), block_of(F.col("ys"), 9).alias("yb"), "node", "root", "minor", F.lit(2).alias("side"))
        pairs = cells(one.unionByName(x).unionByName(y), ["sig", "xb", "yb"]).mapInArrow(crossing(percent), "a long, b long").distinct()
        new = tested(pairs.join(done.select("a", "b"), ["a", "b"], "left_anti"))
        if not new.filter("ok").isEmpty():
            roots = components(done.unionByName(new).filter("ok"))
    remove(spark, temporary)
    return slim.drop("sketch", "wide"), roots


def join(docs: DataFrame, k: int = 3, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    slim, roots = link_nodes(docs, k, percent)
    roots = roots.withColumnRenamed("node", "_node")
    named = slim.join(roots, slim["node"] == roots["_node"], "left").select("doc_id", "n_shingles", F.coalesce("root", "node").alias("root"))
    full, empty = named.filter("n_shingles > 0"), named.filter("n_shingles = 0")
    least = full.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = full.join(least, "root").select("doc_id", "n_shingles", "component_id")
    return out.unionByName(empty.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, k: int = 3, percent: int = PERCENT) -> DataFrame:
    """The documents, one row of each component: that of its smallest doc_id (of repeated ids, the one whose text hashes lowest; without any id, likewise).

    Rows without words are components of their own and all stay."""
    slim, roots = link_nodes(docs, k, percent)
    roots = roots.withColumnRenamed("node", "_node")
    named = slim.filter("n_shingles > 0").join(roots, F.col("node") == F.col("_node"), "left").withColumn("root", F.coalesce("root", "node"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("_id"), F.col("key").alias("_key")))
    kept = cut(named.groupBy("root").agg(least.alias("t")).select("t._id", "t._key"))
    if kept.count() <= FEW:  # rows of 16 bytes; more of them follow the documents by a shuffle
        kept = F.broadcast(kept)
    worded = F.coalesce(F.col("text").rlike(WORD_PATTERN), F.lit(False))
    marked = docs.filter(worded).select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_i"), F.xxhash64("text").alias("_k"))
    known = marked.join(kept, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_k") == F.col("_key"))).select("_row", "_i", "_k")
    # Only rows whose id and text another row has too need a choice between them.
    again = cut(slim.filter("n_shingles > 0").groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(F.count("*").alias("n")).filter("n > 1").drop("n"))
    if not again.isEmpty():
        same = F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_k") == F.col("_key"))
        others = [F.col("_row").getField(c) for c in docs.columns if c not in ("doc_id", "text") and docs.schema[c].dataType.simpleString() in ("string", "bigint", "int", "double")]
        nth = F.row_number().over(Window.partitionBy("_i", "_k").orderBy(F.xxhash64(*others) if others else F.lit(1)))
        one = known.join(again, same, "left_semi").withColumn("_nth", nth).filter("_nth = 1").select("_row", "_i", "_k")
        known = known.join(again, same, "left_anti").unionByName(one)
    return known.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns]).unionByName(docs.filter(~worded))
