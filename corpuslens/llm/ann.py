"""Nearest neighbours by learned partitions.

A bounded sample of vectors gives a neighbour graph; recursive balanced bisection cuts it into parts; a small network
learns which part a vector's neighbours lie in. Every row is indexed under its likeliest part, a query is routed to
its several likeliest parts, and what is found there is ranked by the exact inner product in double precision.

Bounds: the fit sees at most `sample` vectors (4096; documented parameter). The number of parts grows with the root of the
rows; the number of those routed to is the least that reaches `aim` recall on the sample. Rows are never dropped: parts are cut into blocks of at most `block` rows.

Defined results: vectors that are null, zero, of another length than the commonest, or hold null or non-finite
components take no part; neither do null ids. Rows of one id are one candidate (its smallest vector). A query with
fewer than k candidates gets all of them. Equal scores: the smaller id first. Of identical vectors only the k+1
smallest ids can ever be among a query's k, so only these are compared. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

FOUND = "query_id long, vec_id long, score double"


def clean(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, v) of the rows that take part."""
    v = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad).filter(F.exists("v", lambda x: x != 0))
    return v.groupBy("id").agg(F.min("v").alias("v"))


def neighbour_graph(x: np.ndarray, k: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """(n, k) indices of each row's nearest others by inner product, block by block; and the edges both ways."""
    n = len(x)
    k = min(k, n - 1)
    near = np.zeros((n, k), np.int64)
    for a in range(0, n, 512):
        s = x[a : a + 512] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        near[a : a + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return near, np.stack([np.repeat(np.arange(n), k), near.ravel()])


def partition_graph(n: int, edges: np.ndarray, parts: int, seed: int = 0) -> np.ndarray:
    """Balanced parts by recursive bisection: a spectral order, cut in proportion, then improved by swaps."""
    label, rng = np.zeros(n, np.int64), np.random.default_rng(seed)
    todo = [(np.arange(n), parts, 0)]
    while todo:
        nodes, p, base = todo.pop()
        if p <= 1 or len(nodes) < 2:
            label[nodes] = base
            continue
        here = np.full(n, -1)
        here[nodes] = np.arange(len(nodes))
        u, v = here[edges[0]], here[edges[1]]
        ok = (u >= 0) & (v >= 0)
        u, v = np.concatenate([u[ok], v[ok]]), np.concatenate([v[ok], u[ok]])
        degree = np.maximum(np.bincount(u, minlength=len(nodes)), 1)
        x = rng.standard_normal(len(nodes))
        for _ in range(60):
            x = 0.5 * x + 0.5 * np.bincount(u, weights=x[v], minlength=len(nodes)) / degree
            x -= (x * degree).sum() / degree.sum()
            x /= np.abs(x).max() + 1e-300
        left = p // 2
        size = round(len(nodes) * left / p)
        side = np.ones(len(nodes), bool)
        side[np.argsort(x, kind="stable")[:size]] = False
        for _ in range(12):
            other = np.bincount(u, weights=(side[u] != side[v]).astype(float), minlength=len(nodes))
            gain = 2 * other - degree
            a, b = np.flatnonzero(~side), np.flatnonzero(side)
            a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
            m = min(len(a), len(b), max(1, len(nodes) // 20))
            m = int(np.sum(gain[a[:m]] + gain[b[:m]] > 1))
            if not m:
                break
            side[a[:m]], side[b[:m]] = True, False
        todo += [(nodes[~side], left, base), (nodes[side], p - left, base + left)]
    return label


class Router:
    """One hidden layer of rectifiers and a softmax over parts."""

    def __init__(self, dim: int, parts: int, hidden: int = 96, seed: int = 0):
        r = np.random.default_rng(seed)
        self.w = [r.standard_normal((dim, hidden)) * (2 / dim) ** 0.5, np.zeros(hidden), r.standard_normal((hidden, parts)) * (1 / hidden) ** 0.5, np.zeros(parts)]
        self.scale = 1.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x * self.scale) @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]

    def fit(self, x: np.ndarray, target: np.ndarray, epochs: int = 40, batch: int = 128, rate: float = 3e-3, seed: int = 0) -> Router:
        """Adam on the cross entropy with soft targets (the parts of a vector's neighbours)."""
        rng = np.random.default_rng(seed)
        self.scale = 1 / max(float(np.sqrt((x**2).sum(1)).mean()), 1e-12) * len(x[0]) ** 0.5
        x = x * self.scale
        m, s, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(x), batch):
                b = order[a : a + batch]
                pre = x[b] @ self.w[0] + self.w[1]
                act = np.maximum(pre, 0)
                z = act @ self.w[2] + self.w[3]
                z = np.exp(z - z.max(1, keepdims=True))
                d = (z / z.sum(1, keepdims=True) - target[b]) / len(b)
                back = (d @ self.w[2].T) * (pre > 0)
                t += 1
                for i, g in enumerate((x[b].T @ back, back.sum(0), act.T @ d, d.sum(0))):
                    g = g + 1e-4 * self.w[i]
                    m[i] = 0.9 * m[i] + 0.1 * g
                    s[i] = 0.999 * s[i] + 0.001 * g * g
                    self.w[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.999**t)) + 1e-8)
        return self


def train(x: np.ndarray, parts: int, k: int, aim: float, seed: int = 0) -> tuple[Router | None, int]:
    """The router, and to how many parts it must send a query for `aim` recall on the sample."""
    if parts <= 1 or len(x) < 4 * parts:
        return None, 1
    near, edges = neighbour_graph(x)
    label = partition_graph(len(x), edges, parts, seed)
    soft = np.zeros((len(x), parts))
    np.add.at(soft, (np.repeat(np.arange(len(x)), near.shape[1]), label[near].ravel()), 1 / (near.shape[1] + 2))
    soft[np.arange(len(x)), label] += 2 / (near.shape[1] + 2)
    router = Router(x.shape[1], parts, seed=seed).fit(x, soft, seed=seed)
    scores = router.scores(x)
    placed, rank = scores.argmax(1), np.argsort(np.argsort(-scores, axis=1, kind="stable"), axis=1)
    wide, _ = neighbour_graph(x, min(k, len(x) - 1))
    at = rank[np.arange(len(x))[:, None], placed[wide]]
    share = np.cumsum(np.bincount(at.ravel(), minlength=parts)) / at.size
    return router, int(np.searchsorted(share, aim) + 1)


def best_in_block(q_id: np.ndarray, q: np.ndarray, c_id: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query within one block; equal vectors get equal scores wherever they stand."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(0, len(q), 256):
        ids, x = q_id[a : a + 256], q[a : a + 256]
        s = x @ c.T
        s[ids[:, None] == c_id[None, :]] = -np.inf
        kk = min(k, s.shape[1])
        edge = np.partition(s, s.shape[1] - kk, axis=1)[:, s.shape[1] - kk]
        slack = 1e-12 * (1 + np.abs(x).sum(1) * np.abs(c).max())
        i, j = np.nonzero((s >= (edge - slack)[:, None]) & (s > -np.inf))
        score = np.concatenate([(x[i[b : b + 65536]] * c[j[b : b + 65536]]).sum(1) for b in range(0, len(i), 65536)]) if len(i) else np.zeros(0)
        order = np.lexsort((c_id[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        first = np.searchsorted(i, i)
        keep = np.arange(len(i)) - first < k
        out.append((ids[i[keep]], c_id[j[keep]], score[keep]))
    return tuple(np.concatenate([o[n] for o in out]) for n in range(3))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks)
    return np.asarray(arr.flatten(), np.float64).reshape(len(arr), -1)


def search(vectors: DataFrame, query_every: int = 20, k: int = 20, sample: int = 4096, root_per_part: int = 14, least_sample_per_part: int = 32, aim: float = 0.95, block: int = 4096, query_block: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding", seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by `query_every`."""
    spark = vectors.sparkSession
    every = cut(clean(vectors, vec_id, embedding).withColumn("dim", F.size("v")))
    dims = every.groupBy("dim").count().orderBy(F.col("count").desc(), F.col("dim").desc()).limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not dims:
        return empty
    every = every.filter(F.col("dim") == dims[0]["dim"]).drop("dim")
    total = dims[0]["count"]
    # Of identical vectors, the k + 1 smallest ids: what a query's k can hold, itself left out.
    rows = every.withColumn("nth", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("nth") <= k + 1).drop("nth")
    fitted = np.array([r["v"] for r in rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample).collect()], np.float64)
    fitted = np.unique(fitted, axis=0)
    parts = max(1, min(int(total**0.5) // root_per_part, len(fitted) // least_sample_per_part))
    router, probes = train(fitted, parts, k, aim, seed)
    model = spark.sparkContext.broadcast(router)

    def route(n: int):
        def run(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                r = model.value
                if r is None:
                    top = np.zeros((b.num_rows, 1), np.int64)
                else:
                    s = r.scores(matrix(b.column("v")))
                    top = np.argsort(-s, axis=1, kind="stable")[:, :n]
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(list(top), pa.list_(pa.int64()))], ["id", "v", "parts"])

        return run

    shape = "id long, v array<double>, parts array<long>"
    indexed = cut(rows.mapInArrow(route(1), shape).select("id", "v", F.col("parts")[0].alias("part")))
    asked = cut(every.filter(F.pmod(F.col("id"), F.lit(query_every)) == 0).mapInArrow(route(probes), shape))
    blocks = indexed.groupBy("part").agg(F.ceil(F.count("*") / block).cast("int").alias("c_blocks"))

    def find(queries: DataFrame) -> DataFrame:
        """queries: id, v, part (one row a part to look in)."""
        load = queries.groupBy("part").agg(F.ceil(F.count("*") / query_block).cast("int").alias("q_blocks"))
        grid = blocks.join(load, "part")
        c = indexed.join(grid, "part").withColumn("cb", F.pmod(F.xxhash64(F.lit(1), "id"), F.col("c_blocks"))).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q_blocks").cast("long") - 1)))
        q = queries.join(grid, "part").withColumn("qb", F.pmod(F.xxhash64(F.lit(2), "id"), F.col("q_blocks"))).withColumn("cb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c_blocks").cast("long") - 1)))
        keys = ["part", "cb", "qb"]

        def both(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
            i, j, s = best_in_block(left.column("id").to_numpy(), matrix(left.column("v")), right.column("id").to_numpy(), matrix(right.column("v")), k)
            return pa.table({"query_id": i, "vec_id": j, "score": s})

        return q.select("id", "v", *keys).groupBy(*keys).cogroup(c.select("id", "v", *keys).groupBy(*keys)).applyInArrow(both, FOUND)

    def ranked(found: DataFrame) -> DataFrame:
        by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
        return found.withColumn("rank", F.row_number().over(by).cast("int")).filter(F.col("rank") <= k)

    first = cut(ranked(find(asked.select("id", "v", F.explode("parts").alias("part")))))
    # Queries that met too few candidates look everywhere.
    distinct_rows = min(k, indexed.limit(k + 1).count() - 1)
    met = first.groupBy("query_id").count()
    short = asked.join(met, asked["id"] == met["query_id"], "left").filter(F.coalesce("count", F.lit(0)) < distinct_rows).select("id", "v")
    if probes < parts and not short.isEmpty():
        everywhere = short.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
        again = find(everywhere)
        first = ranked(first.join(short, first["query_id"] == short["id"], "left_anti").select("query_id", "vec_id", "score").unionByName(again))
    return first.select("query_id", "rank", "vec_id", "score")
