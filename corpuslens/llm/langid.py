"""Language identification with a bidirectional gated recurrent network over bytes.

Each text is cut into windows of `span` bytes; in each, one gated recurrent layer reads forward and one backward, and a
softmax over both states labels every byte. A document's probabilities pool those of all its bytes (mean of logs).
Gates are hard sigmoids and the candidate x / (1 + |x|): cheap functions that train as well here. The network is trained
in numpy by backpropagation through time on windows of a bounded sample, taken from seeded places of whole texts: of
`per_language` documents of each language (1000) and `most` in all (24,000; both documented parameters), chosen by a hash of their ids.

Defined results: a text that is null or has no letter is `und` with score 0; without any labelled training text every
document is `und`; equal pooled values go to the language first in code-point order; rows without a language or an id
are not learned from; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32_of_id, flat, giving_back, slices

UNKNOWN = "und"


class Network:
    """Parameters: byte tables [2, 3H, 257] (row 256 pads), recurrent [2, 3H, H], output [C, 2H + 1]."""

    def __init__(self, languages: list[str], hidden: int = 6, span: int = 128, seed: int = 0):
        r, h, c = np.random.default_rng(seed), hidden, len(languages)
        self.languages, self.hidden, self.span = languages, h, span
        self.table = (r.standard_normal((2, 3 * h, 257)) * 0.3).astype(np.float32)
        self.back = (r.standard_normal((2, 3 * h, h)) / h**0.5).astype(np.float32)
        self.out = (r.standard_normal((c, 2 * h + 1)) * 0.3).astype(np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.table, self.back, self.out]

    # Rows 0..H-1: update gate z, H..2H-1: reset gate r, the rest: candidate n. h' = n + z (h - n).
    def states(self, x: np.ndarray, keep: bool = False):
        """x: [T, B] byte codes -> both directions' states [2, T, H, B]; with `keep`, what the backward pass needs."""
        t, b = x.shape
        h = self.hidden
        out = np.empty((2, t, h, b), np.float32)
        saved = []
        for d in range(2):
            state, u, table = np.zeros((h, b), np.float32), self.back[d], self.table[d]
            row = np.ascontiguousarray(table)
            for i in range(t) if d == 0 else range(t - 1, -1, -1):
                p = row.take(x[i], axis=1)
                q = u @ state
                g = p[: 2 * h]
                g += q[: 2 * h]
                np.clip(g, -2.5, 2.5, out=g)
                g *= 0.2
                g += 0.5
                a = p[2 * h :]
                a += g[h:] * q[2 * h :]
                n = np.abs(a)
                n += 1
                np.divide(a, n, out=n)
                new = out[d, i]
                np.subtract(state, n, out=new)
                new *= g[:h]
                new += n
                if keep:
                    saved.append((i, g, q[2 * h :], a, n, state))
                state = new
        return (out, saved) if keep else out

    def log_probabilities(self, states: np.ndarray) -> np.ndarray:
        """[C, T, B] log-softmax of every position."""
        _, t, h, b = states.shape
        z = np.tensordot(self.out[:, :h], states[0], axes=(1, 1)) + np.tensordot(self.out[:, h : 2 * h], states[1], axes=(1, 1)) + self.out[:, -1][:, None, None]
        z -= z.max(0)
        z -= np.log(np.exp(z).sum(0))
        return z

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy over all positions and its gradients, backward through time."""
        t, b = x.shape
        h = self.hidden
        states, saved = self.states(x, keep=True)
        logp = self.log_probabilities(states)
        real = (x != 256).astype(np.float32)
        weight = real / real.sum()
        loss = -float((np.take_along_axis(logp, np.broadcast_to(y, (1, t, b)), 0)[0] * weight).sum())
        dz = np.exp(logp)
        np.put_along_axis(dz, np.broadcast_to(y, (1, t, b)), np.take_along_axis(dz, np.broadcast_to(y, (1, t, b)), 0) - 1, 0)
        dz *= weight
        dout = np.zeros_like(self.out)
        dout[:, -1] = dz.sum((1, 2))
        dtable, dback = np.zeros_like(self.table), np.zeros_like(self.back)
        at = 0
        for d in range(2):
            dout[:, d * h : (d + 1) * h] = np.einsum("ctb,thb->ch", dz, states[d], optimize=True)
            above = np.tensordot(self.out[:, d * h : (d + 1) * h], dz, axes=(0, 0))  # [H, T, B]
            carry = np.zeros((h, b), np.float32)
            for i, g, qn, a, n, before in reversed(saved[at : at + t]):
                dh = carry + above[:, i]
                z, r = g[:h], g[h:]
                dn = dh * (1 - z)
                da = dn / (1 + np.abs(a)) ** 2
                dg = np.concatenate([dh * (before - n), da * qn]) * 0.2
                dg[(g <= 0) | (g >= 1)] = 0
                dq = np.concatenate([dg, da * r])
                dp = np.concatenate([dg, da])
                carry = dh * z + self.back[d].T @ dq
                dback[d] += dq @ before.T
                order = np.argsort(x[i], kind="stable")
                codes, first = np.unique(x[i][order], return_index=True)
                dtable[d][:, codes] += np.add.reduceat(dp[:, order], first, axis=1)
            at += t
        return loss, [dtable, dback, dout]

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 400, batch: int = 192, rate: float = 0.02, seed: int = 0) -> Network:
        """x: [N, T] windows, y: [N] language numbers. Adam with a rate that falls to a tenth."""
        rng, w = np.random.default_rng(seed), self.parameters()
        m, s = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
        for k in range(1, steps + 1):
            pick = rng.integers(0, len(x), batch)
            _, grads = self.gradients(np.ascontiguousarray(x[pick].T), y[pick])
            norm = float(np.sqrt(sum(float((g**2).sum()) for g in grads)))
            lr = rate * (1 - 0.9 * k / steps)
            for a, mm, ss, g in zip(w, m, s, grads, strict=True):
                g = g * min(1.0, 1.0 / max(norm, 1e-9))
                mm *= 0.9
                mm += 0.1 * g
                ss *= 0.99
                ss += 0.01 * g * g
                a -= lr * (mm / (1 - 0.9**k)) / (np.sqrt(ss / (1 - 0.99**k)) + 1e-6)
        return self

    def pool(self, data: np.ndarray, offsets: np.ndarray, batch: int = 1536) -> np.ndarray:
        """Mean log-probabilities [rows, C] over all bytes of each row."""
        n, t, h = len(offsets) - 1, self.span, self.hidden
        sizes = np.diff(offsets)
        count = -(-sizes // t)
        owner = np.repeat(np.arange(n), count)
        first = np.cumsum(count) - count
        start = offsets[owner] + (np.arange(len(owner)) - first[owner]) * t
        length = np.minimum(t, offsets[owner + 1] - start)
        padded = np.concatenate([data, np.zeros(t, np.uint8)])
        rows = np.ndarray((len(data) + 1, t), np.uint8, padded.data, strides=(1, 1))
        # The gates' 0.2 x + 0.5 goes into the tables once.
        scale = np.ones((3 * h, 1), np.float32)
        scale[: 2 * h] = 0.2
        tables = self.table * scale
        tables[:, : 2 * h] += 0.5
        backs = self.back * scale
        total = np.zeros((n, len(self.languages)))
        for a in range(0, len(owner), batch):
            k = length[a : a + batch]
            x = np.ascontiguousarray(rows[start[a : a + batch]].T).astype(np.intp)
            pad = None
            if int(k.min()) < t:
                pad = np.arange(t)[:, None] >= k
                x[pad] = 256
            z = self._scan(x, tables, backs)
            lse = np.log(np.exp(z).sum(1))
            if pad is not None:
                lse[pad] = 0
                z[np.broadcast_to(pad[:, None, :], z.shape)] = 0
            np.add.at(total, owner[a : a + batch], (z.sum(0) - lse.sum(0)).T)
        return total / np.maximum(sizes, 1)[:, None]

    def _scan(self, x: np.ndarray, tables: np.ndarray, backs: np.ndarray) -> np.ndarray:
        """Logits [T, C, B] of every position; as states(), without what only training needs. States are below one, so the logits are small."""
        t, b = x.shape
        h, c = self.hidden, len(self.languages)
        z = np.empty((t, c, b), np.float32)
        p, q, n, one, state, w = (np.empty(k, np.float32) for k in ((3 * h, b), (3 * h, b), (h, b), (h, b), (h, b), (c, b)))
        for d in range(2):
            table, u, out = tables[d], backs[d], np.ascontiguousarray(self.out[:, d * h : (d + 1) * h])
            state[:] = 0
            for i in range(t) if d == 0 else range(t - 1, -1, -1):
                np.take(table, x[i], axis=1, out=p, mode="clip")
                np.matmul(u, state, out=q)
                g, a = p[: 2 * h], p[2 * h :]
                g += q[: 2 * h]
                np.maximum(g, 0, out=g)
                np.minimum(g, 1, out=g)
                np.multiply(g[h:], q[2 * h :], out=n)
                a += n
                np.abs(a, out=one)
                one += 1
                np.divide(a, one, out=n)
                state -= n
                state *= g[:h]
                state += n
                if d:
                    np.matmul(out, state, out=w)
                    z[i] += w
                else:
                    np.matmul(out, state, out=z[i])
        z += self.out[:, -1][:, None]
        return z


def pad_windows(windows: list[bytes], span: int) -> np.ndarray:
    """[windows, span] byte codes; what is missing is 256."""
    x = np.full((len(windows), span), 256, np.int64)
    for row, w in zip(x, windows, strict=True):
        row[: len(w)] = np.frombuffer(w, np.uint8)
    return x


def has_letter(text: str = "text") -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def training_windows(docs: DataFrame, per_language: int, most: int, span: int, each: int, seed: int) -> DataFrame:
    """(lang, windows): `each` windows of `span` bytes from seeded places of whole texts, of at most `per_language` rows a language
    and about `most` in all, in the order of a hash of their ids. Only these bytes leave the executors."""
    usable = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & has_letter())
    n_languages = usable.agg(F.approx_count_distinct("lang")).first()[0]
    per_language = max(1, min(per_language, most // max(n_languages, 1)))
    key = F.col("doc_id").cast("string")
    size = F.octet_length("text")

    def window(k: int) -> Column:
        at = F.pmod(F.xxhash64(F.lit(seed + k), key), F.greatest(size - span + 1, F.lit(1)))
        return F.substring(F.encode("text", "utf-8"), (at + 1).cast("int"), F.lit(span))

    # Short texts give one window; up to 1000 rows a language Spark limits each task's share before the shuffle.
    windows = F.filter(F.array(*[F.when((size >= span * (k + 1)) | F.lit(k == 0), window(k)) for k in range(each)]), lambda w: w.isNotNull())
    by = Window.partitionBy("lang").orderBy("_key", "doc_id", "windows")
    rows = usable.select("lang", F.xxhash64(F.lit(seed), key).alias("_key"), "doc_id", windows.alias("windows"))
    return rows.withColumn("_nth", F.row_number().over(by)).filter(F.col("_nth") <= per_language).select("lang", "_key", "doc_id", "windows")


def train(docs: DataFrame, per_language: int = 1000, most: int = 24_000, hidden: int = 6, span: int = 128, train_span: int = 64, steps: int = 400, seed: int = 11) -> Network | None:
    """The network learned from docs (doc_id, text, lang); None if no row has an id, a language and a letter."""
    some = training_windows(docs, per_language, most, train_span, 2, seed).collect()
    if not some:
        return None
    some.sort(key=lambda r: (r["lang"], r["_key"], r["doc_id"], r["windows"]))
    languages = sorted({r["lang"] for r in some})
    number = {c: i for i, c in enumerate(languages)}
    x = pad_windows([bytes(w) for r in some for w in r["windows"]], train_span)
    y = np.array([number[r["lang"]] for r in some for _ in r["windows"]])
    return Network(languages, hidden, span, seed).fit(x, y, steps, seed=seed)


def predict(docs: DataFrame, network: Network | None, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """`docs` (with a text) and two columns: the likeliest language and its pooled probability."""
    names = [c for c in docs.columns if c not in (lang, score, "_letter")]
    model = docs.sparkSession.sparkContext.broadcast(network)
    schema = docs.select(*names).schema.add(lang, "string").add(score, "double")

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for b in batches:
            letter, data_all = np.asarray(b.column(len(names)).to_numpy(zero_copy_only=False), bool), flat(b.column(names.index("text")))
            labels, scores = np.full(b.num_rows, UNKNOWN, object), np.zeros(b.num_rows)
            if net is not None:
                data, offsets = data_all
                for a, z in slices(offsets, 4 << 20):
                    part = net.pool(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a])
                    p = np.exp(part - part.max(1, keepdims=True))
                    p /= p.sum(1, keepdims=True)
                    ok = letter[a:z]
                    labels[a:z][ok] = np.array(net.languages, object)[part.argmax(1)][ok]
                    scores[a:z][ok] = p.max(1)[ok]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], [*names, lang, score])

    return docs.select(*names, has_letter().alias("_letter")).mapInArrow(run, schema)


def identify(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score. Learns from documents whose crc32(doc_id) mod 5 is not 0."""
    held_out = F.coalesce(F.pmod(crc32_of_id(), F.lit(5)) == 0, F.lit(False))
    network = train(docs.filter(~held_out), **options)
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), network).drop("text")


def keep_identified(docs: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """The documents whose language was recognised (with at least `least` probability); all columns are kept as they are."""
    held_out = F.coalesce(F.pmod(crc32_of_id(), F.lit(5)) == 0, F.lit(False))
    network = train(docs.filter(~held_out), **options)
    seen = predict(docs, network, "_lang_seen", "_lang_score")
    return seen.filter((F.col("_lang_seen") != UNKNOWN) & (F.col("_lang_score") >= least)).select(*docs.columns)
