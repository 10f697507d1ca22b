"""The pipeline's Jaccard stage: five words, 80 %."""

import itertools
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from corpuslens.llm import jaccard


def shingles(text, k):
    w = (text or "").lower().split()
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def components(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}
    for a, b in itertools.combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * len(sets[a] | sets[b]) and root[a] != root[b]:
            old, new = sorted((root[a], root[b]), reverse=True)
            root = {i: new if r == old else r for i, r in root.items()}
    return sorted((i, len(sets[i]), root[i]) for i in sets)


def test_stage_drops_copies_between_the_thresholds(spark):
    base = [f"w{i}" for i in range(100)]
    copy = [f"v{i}" if i in (30, 70) else w for i, w in enumerate(base)]
    far = [f"v{i}" if i in (20, 50, 80) else w for i, w in enumerate(base)]
    rows = [(1, " ".join(base)), (2, " ".join(copy)), (3, " ".join(x + "x" for x in far)), (4, " ".join(far))]
    common = len(shingles(rows[0][1], 5) & shingles(rows[1][1], 5)) / len(shingles(rows[0][1], 5) | shingles(rows[1][1], 5))
    assert common >= 0.8
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.jaccard_join(spark, df, "").collect()) == [1, 3, 4]
    assert jaccard.keep_one(df).count() == 4


@pytest.mark.parametrize(("seed", "often"), [(1, 32), (2, 1)])
def test_lower_threshold_equals_brute_force(spark, monkeypatch, seed, often):
    monkeypatch.setattr(jaccard, "OFTEN", often)
    rng = random.Random(seed)
    texts = ["", None, "one", "ONE", "a b c d", "a b c d e f g h", "a b c d e f g h i", "b c d e f g h i"]
    line = " ".join(f"c{i}" for i in range(12))
    for _ in range(15):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.choice([6, 8, 9, 12, 30, 80, 200]))]
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = f"v{rng.randint(0, 10**6)}"
            texts.append(" ".join(w[rng.randint(0, len(w) // 9) :]) + (" " + line if rng.random() < 0.3 else ""))
    rows = list(zip(rng.sample(range(10_000), len(texts)), texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = components(rows, 5, 80)
    assert want != sorted((i, n, i) for i, n, _ in want)
    assert sorted(tuple(r) for r in jaccard.join(df, 5, 80).collect()) == want


def long_texts(rng):
    """Eight long texts that share a passage and little else, two of them with a near copy."""
    line = " ".join(f"c{i}" for i in range(60))
    texts = [" ".join(f"w{rng.randint(0, 10**9)}" for _ in range(rng.randint(1500, 2500))) + " " + line for _ in range(8)]
    return texts + [t.replace(" w1", " v1", 20) for t in texts[:2]]


def test_long_texts_equal_brute_force_and_hopeless_pairs_move_no_sets(spark, monkeypatch):
    met, cut = [], jaccard.cut

    def counted(df, into=None):
        out = cut(df, into)
        if out.columns == ["hub", "part", "node"]:
            met.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "cut", counted)
    rows = list(enumerate(long_texts(random.Random(6)), 1))
    want = components(rows, 5, 80)
    assert [r for _, _, r in want] == [1, 2, 3, 4, 5, 6, 7, 8, 1, 2]
    assert sorted(tuple(r) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()) == want
    assert sum(met) == 4  # two pairs, both ends of each


def test_wide_sketches_never_differ_in_more_bits_than_sets_do_in_shingles():
    rng = np.random.default_rng(7)
    for n in (400, 512, 513, 1000, 1024, 1025, 5000):
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        for y in (x[: n - n // 6], np.unique(np.concatenate([x, rng.integers(0, 2**63, n // 4, dtype=np.uint64)])), rng.integers(0, 2**63, n, dtype=np.uint64)):
            edges = np.array([0, len(x), len(x) + len(y)])
            a, b = jaccard.wide_sketches(np.concatenate([x, y]), edges)
            assert [w is not None for w in (a, b)] == [len(x) > jaccard.SKETCH, len(y) > jaccard.SKETCH]
            if a and b:
                assert jaccard.apart(a, b) == jaccard.apart(b, a) <= len(np.setxor1d(x, y))
                folded = np.bitwise_xor.reduce(np.frombuffer(a, np.uint8).reshape(-1, jaccard.SKETCH // 8), axis=0)
                assert (folded.view(np.uint64) == jaccard.sketches(x, np.array([0, len(x)]))[0]).all()
    assert jaccard.wide_sketches(np.zeros(0, np.uint64), np.array([0, 0])) == [None]


def dense(groups: int, size: int, **columns):
    """Sorted rows of groups in which all rows are near each other, a batch for each group."""
    nodes, sketch = np.arange(1, size + 1) * 7 % 10007, bytes(jaccard.SKETCH // 8)
    for g in range(groups):
        shared = {"node": np.sort(nodes), "n": np.full(size, 300, np.int32), "root": np.arange(size), "sketch": [sketch] * size}
        yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in ({"sig": np.full(size, g)} | {k: np.resize(v, size) for k, v in columns.items()} | shared).items()})


def test_many_groups_of_copies_take_bounded_memory():
    """All near pairs of a table of such groups took gigabytes (20 groups of 1600 rows: 2.7 GB)."""
    tracemalloc.start()
    hubs = pa.Table.from_batches(list(jaccard.hubs(80)(dense(64, 512, block=np.int32(0)))))
    crossing = [b.num_rows for b in jaccard.crossing(80)(dense(64, 512, xb=np.int32(0), yb=np.int32(0), side=np.int32(0), minor=np.array([True])))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Every node is near all 511 others; the least is the hub of the rest, and has the second as its own.
    least, second = np.sort(np.arange(1, 513) * 7 % 10007)[:2]
    assert hubs.num_rows == 64 * 512 and set(hubs.column("degree").to_pylist()) == {511}
    assert all(p == (second if v == least else least) for v, p in zip(hubs.column("node").to_pylist(), hubs.column("partner").to_pylist(), strict=True))
    assert 512 * 511 // 2 <= sum(crossing) <= 64 * 512 * 511 // 2
    assert peak < 300e6


def links(rng):
    """A path in mixed order, a star whose hub is its largest node, a cycle, and links at random; with the least node of each node's component."""
    path, ring = rng.sample(range(10_000, 20_000), 300), rng.sample(range(20_000, 30_000), 50)
    pairs = [*zip(path, path[1:]), *((40_000, 30_000 + i) for i in range(200)), *zip(ring, ring[1:] + ring[:1])]
    pairs += [tuple(rng.sample(range(2000), 2)) for _ in range(1200)]
    root = {x: x for p in pairs for x in p}

    def least(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((least(a), least(b)))
        root[b] = a
    rng.shuffle(pairs)
    return [(max(p), min(p)) for p in pairs], sorted((x, least(x)) for x in root)


@pytest.mark.parametrize("at_once", [200_000, 100])
def test_components_equal_brute_force_in_one_task_and_by_rounds(spark, monkeypatch, at_once):
    monkeypatch.setattr(jaccard, "ONE_TASK", at_once)
    pairs, want = links(random.Random(3))
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(7)
    assert sorted(tuple(r) for r in jaccard.components(edges).collect()) == want


def test_components_of_no_links(spark):
    assert jaccard.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_few_links_take_few_jobs(spark):
    """What the driver keeps of jobs, stages and tasks is its memory; shuffles to connect a few thousand links were most of them."""
    pairs, want = links(random.Random(4))
    edges = jaccard.cut(spark.createDataFrame(pairs, "a long, b long").repartition(7))
    spark.sparkContext.setJobGroup("few links", "")
    try:
        assert len(jaccard.components(edges).collect()) == len(want)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few links")) <= 6
