"""Jaccard join, mixing, neighbours, packing and the pipeline against brute force and exact invariants."""

import itertools
import random
import zlib

import numpy as np
import pytest

from corpuslens.llm import ann, jaccard, mixing, packing

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string"


def brute_components(rows, k=3):
    sets = {}
    for i, text in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 90 * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return sorted((i, len(s), find(i)) for i, s in sets.items())


def near_copies(rng, groups, size, length):
    rows = []
    for _ in range(groups):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(*length))]
        for _ in range(rng.randint(1, size)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, len(w) // 60])):
                w[rng.randrange(len(w))] = f"v{rng.randint(0, 10**6)}"
            if rng.random() < 0.3:
                w = w[: len(w) - rng.randint(0, 2)] + ["end"] * rng.randint(0, 2)
            base = w if rng.random() < 0.5 else base  # chains of copies of copies
            rows.append(" ".join(w))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = near_copies(rng, 12, 8, (9, 200)) + near_copies(rng, 1, 40, (100, 120)) + near_copies(rng, 30, 2, (8, 14))
    texts += ["", None, " \t", "one", "ONE", "one two", "One Two", "a b c", "A B\nC", "é b c", "É b c"]
    ids = rng.sample(range(10_000), len(texts))
    rows = list(zip(ids, texts))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string").repartition(5)
    got = sorted(tuple(r) for r in jaccard.join(df).collect())
    assert got == brute_components(rows)
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in got})


def test_jaccard_of_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, "q r s"), (None, None)], "doc_id long, text string")
    got = sorted(map(str, jaccard.join(df).collect()))
    assert got == sorted(map(str, [*spark.createDataFrame([(None, 2, 4), (4, 2, 4), (4, 2, 4), (None, 1, None), (None, 0, None)], "doc_id long, n_shingles long, component_id long").collect()]))
    assert jaccard.join(df.limit(0)).count() == 0


def test_segments_catch_every_pair():
    rng = np.random.default_rng(0)
    s = jaccard.Schemes(90, 400)
    s.allotted = np.where(rng.random(len(s.allotted)) < 0.3, 2, 1).astype(np.int8)
    for b in range(s.planned):
        a, z = s.offset[b], s.offset[b + 1]
        spare = int(s.allotted[a:z].sum()) - int(s.differ[b]) - 1
        for i in rng.permutation(np.arange(a, z)):
            if spare >= s.allotted[i]:
                spare -= int(s.allotted[i])
                s.allotted[i] = 0
    for _ in range(300):
        r = int(rng.integers(9, 900))  # bands beyond the planned ones too
        x = rng.integers(0, 2**63, r, dtype=np.uint64)
        drop = int(rng.integers(0, r // 10 + 1))
        y = np.unique(np.concatenate([x[drop:], rng.integers(0, 2**63, int(rng.integers(0, drop + 1)), dtype=np.uint64)]))
        x = np.unique(x)
        common = len(np.intersect1d(x, y))
        if 100 * common < 90 * (len(x) + len(y) - common):
            continue
        row, _, _, sig = s.signatures(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]))
        assert set(sig[row == 0].tolist()) & set(sig[row == 1].tolist())


def test_sketches_never_differ_in_more_bits_than_sets_do_in_shingles():
    rng = np.random.default_rng(3)
    for n in (1, 5, 60, 300, 3000):
        x = rng.integers(0, 2**63, n, dtype=np.uint64)
        y = np.concatenate([x[: n - n // 7], rng.integers(0, 2**63, n // 5, dtype=np.uint64)])
        a, b = jaccard.sketches(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]))
        assert int(np.bitwise_count(a ^ b).sum()) <= len(np.setxor1d(x, y))
    assert not jaccard.sketches(np.zeros(0, np.uint64), np.array([0, 0])).any()


def test_near_pairs_of_small_and_large_groups():
    rng = np.random.default_rng(4)
    start = np.cumsum([0, 1, 2, 64, 65, 300, 3])
    m = int(start[-1])
    n, root = rng.integers(90, 110, m), rng.integers(0, 40, m)
    flips = (np.uint64(1) << rng.integers(0, 63, (m, 8)).astype(np.uint64)) * (rng.random((m, 8)) < 0.7)
    sketch = rng.integers(0, 2**63, (1, 8), dtype=np.uint64) ^ flips.astype(np.uint64)
    i, j = jaccard.near_pairs(start, n, sketch, root, 90)
    group = np.searchsorted(start, np.arange(m), side="right")
    want = {(a, b) for a in range(m) for b in range(a + 1, m) if group[a] == group[b] and jaccard.near(np.array([a]), np.array([b]), n, sketch, root, 90)[0]}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and len(i) == len(want) > 100


@pytest.mark.parametrize("block", [4, 16])
def test_jaccard_with_buckets_over_many_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(block)
    rows = list(enumerate(near_copies(rng, 2, 70, (100, 120)) + near_copies(rng, 3, 5, (40, 60)), 1))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in jaccard.join(df).collect()) == brute_components(rows)


def test_jaccard_of_very_long_texts(spark):
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 10**9)}" for _ in range(300_000)]
    near = [f"v{i}" if i % 80 == 0 else w for i, w in enumerate(base)]  # 3 of 80 shingles differ
    far = [f"u{i}" if i % 20 == 0 else w for i, w in enumerate(base)]
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(x + "x" for x in far)), (4, " ".join(far))], "doc_id long, text string")
    assert [(r["doc_id"], r["component_id"]) for r in jaccard.join(df).orderBy("doc_id").collect()] == [(1, 1), (2, 1), (3, 3), (4, 4)]


def test_keep_one_keeps_texts_of_repeated_and_missing_ids(spark):
    one, two = "a b c d e f", "q r s t u v"
    rows = [(1, one, "x"), (1, two, "x"), (1, two, "y"), (2, one, "x"), (None, one, "x"), (None, "k l m n", "x"), (None, "k l m n", "x"), (3, None, "x"), (3, " ", "x"), (None, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = sorted(((r["doc_id"], r["text"]) for r in jaccard.keep_one(df).collect()), key=str)
    assert got == sorted([(1, one), (1, two), (None, "k l m n"), (3, None), (3, " "), (None, None)], key=str)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, i) for i in range(101, 120)]
    got = {r["node"]: r["root"] for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 120))


def water_fill(sizes, weights, limit=3):
    total, goal, open_ = sum(sizes.values()), {}, dict(weights)
    rest = total
    while open_:
        level = rest / sum(open_.values())
        over = [s for s in open_ if level * open_[s] > limit * sizes[s]]
        if not over:
            return goal | {s: level * w for s, w in open_.items()}
        for s in over:
            goal[s] = limit * sizes[s]
            rest -= goal[s]
            del open_[s]
    return goal


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mixing(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(300):
        s = rng.choice(["a"] * 40 + ["b", "c", "d", "B", "é", None])
        n = rng.choice([0, 1, 5, rng.randint(1, 300)])
        rows.append((i, " ".join(["w"] * n) + rng.choice(["", " ", "\n"]) if n or rng.random() < 0.5 else None, "en", s, 1, "x"))
    rows += [rows[4], rows[5]]
    df = spark.createDataFrame(rows, DOCS)
    out = mixing.mix(df).collect()
    size = {i: len((t or "").split()) for i, t, *_ in rows}
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    totals = {s: sum(len((r[1] or "").split()) for r in rows if r[3] == s) for s in sources}
    goal = water_fill(totals, {s: (1, 2, 3)[k % 3] for k, s in enumerate(sources)})
    assert len(out) == len(rows)
    taken = dict.fromkeys(sources, 0)
    for r in out:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == totals[r["source"]]
        assert abs(r["target"] - goal[r["source"]]) < 1e-6 * max(1, goal[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sources:
        assert abs(taken[s] - goal[s]) <= max(0.02 * goal[s], 3)
    assert sorted(map(str, mixing.mix(df.repartition(3)).collect())) == sorted(map(str, out))
    mixed = mixing.mix_documents(df)
    assert mixed.columns == df.columns
    words = {}
    for r in mixed.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    want = {}
    for r in out:
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["taken"]
    assert words == {i: n for i, n in want.items() if n}


def test_mixing_of_odd_tables(spark):
    df = spark.createDataFrame([(1, None, None), (None, "a b", None)], "doc_id long, text string, source string")
    assert {r["doc_id"]: r["taken"] for r in mixing.mix(df).collect()} == {1: 0, None: 2}
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.mix(df.filter("text is null")).collect()[0]["target"] == 0


def test_apportionment_is_by_highest_quotients(spark):
    rng = random.Random(9)
    rows = [(g, p, rng.choice([0, rng.randint(1, 2000)])) for g in range(6) for p in range(rng.randint(1, 9))]
    seats = [1, 2, 7, 40, 333, 5]
    from pyspark.sql import functions as F

    got = mixing.apportion(spark.createDataFrame(rows, "g long, p long, v long"), ["g"], "v", F.element_at(F.array(*map(F.lit, seats)), (F.col("g") + 1).cast("int")), "won").collect()
    for g in range(6):
        own = {p: v for x, p, v in rows if x == g}
        won = dict.fromkeys(own, 0)
        for _ in range(seats[g] if sum(own.values()) else 0):
            best = min(own, key=lambda p: (-own[p] / (2 * won[p] + 1), p))
            won[best] += 1
        assert {r["p"]: r["won"] for r in got if r["g"] == g} == won


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((30, 16)) * 2
    x = np.concatenate([centres[rng.integers(0, 30, 3000)] + rng.standard_normal((3000, 16)), np.tile(centres[0], (400, 1))]).astype(np.float32)
    rows = [(i * 5, [float(v) for v in r], 1) for i, r in enumerate(x)]
    odd = [(3, None, 0), (20_001, [0.0] * 16, 0), (20_003, [float("nan")] * 16, 0), (20_004, [1.0] * 3, 0), (None, [1.0] * 16, 0), (20_005, [None] + [1.0] * 15, 0), (20_006, [float("inf")] * 16, 0), rows[7]]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, part int")
    got = {}
    for r in ann.search(df, k=10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ids, x = np.arange(len(x)) * 5, x.astype(float)
    queries = [i for i in ids if i % 20 == 0]
    assert sorted(got) == queries
    hit = 0
    for q in queries:
        s = (x * x[q // 5]).sum(1)
        s[q // 5] = -np.inf
        best = np.lexsort((ids, -s))[:10]
        assert [g[0] for g in got[q]] == list(range(1, 11))
        assert all(abs(g[2] - s[g[1] // 5]) < 1e-9 for g in got[q])
        assert got[q] == sorted(got[q], key=lambda g: (-g[2], g[1]))
        hit += len({g[1] for g in got[q]} & set(ids[best].tolist()))
    assert hit >= 0.9 * 10 * len(queries)


def test_neighbours_of_odd_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [1.0, 0.0]), (7, [0.5, 0.5])], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in ann.search(df).collect())
    assert got == [(0, 1, 20, 1.0), (0, 2, 7, 0.5), (20, 1, 0, 1.0), (20, 2, 7, 0.5)]
    assert ann.search(df.limit(0)).count() == 0 and ann.search(df.filter("vec_id = 0")).count() == 0


def test_knapsack_is_exact():
    rng = random.Random(2)
    lengths = np.array(sorted(rng.sample(range(1, 40), 6)))
    value = np.array([rng.random() for _ in lengths])
    best, last = packing.knapsack(value, lengths, 60)
    exact = [0.0] * 61
    for c in range(1, 61):
        exact[c] = max([exact[c - 1]] + [exact[c - n] + v for n, v in zip(lengths, value) if n <= c])
    assert np.allclose(best, exact)
    p = packing.pattern_of(last, 60)
    assert sum(n * t for n, t in p.items()) <= 60
    assert abs(sum(value[list(lengths).index(n)] * t for n, t in p.items()) - exact[60]) < 1e-9


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_every_piece_in_few_sequences(seed):
    rng = random.Random(seed)
    histogram = {rng.randint(1, 100): rng.randint(1, 60) for _ in range(rng.randint(1, 60))}
    out = packing.plan(histogram, 100)
    used = {}
    for p, n in out:
        assert n > 0 and sum(a * b for a, b in p) <= 100
        for a, b in p:
            used[a] = used.get(a, 0) + n * b
    assert used == histogram
    # Lower bounds: for each k, pieces over 100 - k need a sequence each, which pieces of k or more can't join.
    bound = max(-(-sum(100 * c if n > 100 - k else n * c if n >= k else 0 for n, c in histogram.items()) // 100) for k in range(51))
    assert sum(n for _, n in out) <= bound * 1.03 + 2


TEXTS = ["hello world", "  two  spaces\n\nlines ", None, "", "I'll don't 123 4567 éè 漢字 \U0001f600", "x<|endoftext|>y z", "a b  c", "tab\there there", "word " * 3000, " lead and trail "]


def test_tokens_equal_the_librarys():
    import public_tokenizers
    from tokenizers import Tokenizer

    whole, ours = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.Tokens()
    rng = random.Random(6)
    odd = "ab Zé漢字\u0301\u200b\u00a0\t\n\r'’sd0١²🙂.,!?-_<|>\x00\x7f"
    strange = ["".join(rng.choices(odd, k=rng.randint(1, 40))) for _ in range(2000)] + ["".join(chr(rng.choice([rng.randint(1, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(12)) for _ in range(500)]
    for t in TEXTS + strange:
        assert np.frombuffer(ours(t or ""), "<u4").tolist() == whole.encode(t or "", add_special_tokens=False).ids


def test_packing(spark):
    rng = random.Random(1)
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(100 + i, " ".join(rng.choices(["alpha", "beta,", "Gamma"], k=rng.randint(0, 1500))), "x") for i in range(120)] + [(3, "", "x"), (None, "null id", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string")
    out = packing.pack(df, capacity=256).collect()
    tokens, want = packing.Tokens(), []
    for i, t, _ in rows:
        ids = tokens(t or "") + bytes(4)
        n = len(ids) // 4
        first = n if n <= 256 else n % 256 or 256
        for k, (a, z) in enumerate(itertools.pairwise([0, *range(first, n + 1, 256)])):
            want.append((i, k, a, z - a, zlib.crc32(ids[4 * a : 4 * z])))
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])) for r in out)
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(spans)) and sum(spans[-1]) <= 256
    assert len(by) <= sum(r["length"] for r in out) / 256 * 1.03 + 2
    assert packing.pack(df.limit(0)).count() == 0


def test_pipeline_stages_chain(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    rows = []
    for i in range(120):
        lang, letters = (("aa", "abcdefgh"), ("zz", "stuvwxyz"))[i % 2]
        rows.append((i, " ".join("".join(rng.choices(letters, k=4)) for _ in range(rng.randint(30, 90))) + f" ip 10.0.0.{i}", lang, f"s{i % 4}", 1))
    rows += [(500, rows[0][1], "aa", "s1", 1), (501, None, None, "s1", None), (502, "12345", None, None, 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs)
    ids = [sorted({r["doc_id"] for r in d.select("doc_id").collect()}) for d in seen]
    assert ids[0] == [*range(120), 500] and ids[1] == ids[2] == [*range(120)]
    assert not any("10.0.0." in r["text"] for r in seen[2].collect())
    words = sum(len(r["text"].split()) for r in seen[2].collect())
    assert abs(sum(len(r["text"].split()) for r in seen[3].collect()) - words) <= 0.02 * words
    assert seen[4].agg({"length": "sum"}).first()[0] > words
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen[4].count()
