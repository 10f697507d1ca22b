"""Language ID, substring dedup, pseudonyms, quality and toxicity against brute force and held-out accuracy."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from corpuslens.llm import langid, pii, quality, substring, toxicity
from corpuslens.llm.common import flat, pack_sorted, unpack_sorted, windows, word_hashes, word_spans

DOCS = "doc_id long, text string, lang string, source string, n_chars long, block string"


def words(rng, letters, n):
    return " ".join("".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    rows = []
    for i in range(160):
        lang, letters = (("aa", "abcdefgh"), ("zz", "stuvwxyzéü"))[i % 2]
        text = words(rng, letters, rng.randint(5, 60))
        rows.append((i, text, lang, f"s{i % 3}", len(text), "x"))
    rows += [(1000, None, "aa", None, None, None), (1001, "", None, "s0", 0, None), (1002, "123 456 !!", None, "s0", 9, None), (None, "abc abd", None, "s0", 7, None), (5, rows[5][1], "zz", "s2", 1, None)]
    return rows


def test_word_spans_and_hashes_follow_rows():
    texts = ["a b", "", "bb  a\tb\n", None, "long-word-of-many-bytes long-word-of-many-bytes"]
    data, offsets = flat(pa.array(texts))
    starts, ends, rows = word_spans(data, offsets)
    got = [bytes(data[a:b]) for a, b in zip(starts, ends)]
    assert got == [b"a", b"b", b"bb", b"a", b"b", b"long-word-of-many-bytes", b"long-word-of-many-bytes"]
    assert rows.tolist() == [0, 0, 2, 2, 2, 4, 4]
    h = word_hashes(data, starts, ends)
    assert h[0] == h[3] and h[1] == h[4] and h[5] == h[6] and len(set(h.tolist())) == 4
    _, at = windows(h, rows, 2)
    assert at.tolist() == [0, 2, 3, 5]


def test_sorted_values_round_trip():
    rng = np.random.default_rng(0)
    for v in ([], [5], [1, 2, 2**64 - 1], np.unique(rng.integers(0, 2**63, 500))):
        v = np.array(v, np.uint64)
        assert (unpack_sorted(pack_sorted(v)) == v).all()


def test_gradients_match_differences():
    net = langid.Network(["a", "b", "c"], hidden=3, seed=2)
    for w in net.parameters():
        w += 0.05
    x = np.random.default_rng(1).integers(0, 257, (6, 5))
    y = np.array([0, 1, 2, 1, 0])
    _, grads = net.gradients(x, y)
    for w, g in zip(net.parameters(), grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        keep = w[at]
        w[at] = keep + 1e-2
        up = net.gradients(x, y)[0]
        w[at] = keep - 1e-2
        down = net.gradients(x, y)[0]
        w[at] = keep
        assert abs((up - down) / 2e-2 - g[at]) < 1e-3


def test_scanned_logits_are_the_trained_networks():
    net = langid.Network(["a", "b", "c"], hidden=4, span=16, seed=3)
    texts = [b"short", b"", bytes(range(1, 200)), b"x" * 16, "é漢".encode() * 40]
    data, offsets = flat(pa.array(texts, pa.binary()))
    got = net.pool(data, offsets, batch=3)
    for i, t in enumerate(texts):
        if t:
            total = np.zeros(3)
            for a in range(0, len(t), 16):
                x = langid.pad_windows([t[a : a + 16]], 16).T
                total += net.log_probabilities(net.states(x))[:, x[:, 0] < 256].sum((1, 2))
            assert np.allclose(got[i], total / len(t), atol=1e-4)


def test_training_windows_are_bounded_and_from_whole_texts(spark):
    text = "".join(chr(97 + i % 26) * 64 for i in range(2000))
    rows = [(i, text, "aa") for i in range(30)] + [(7, text, "aa")] * 20 + [(100 + i, "tiny é", "zz") for i in range(5)] + [(None, text, "aa"), (999, "12", "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.training_windows(df, 10, 1000, 64, 2, 1).collect()
    assert sorted(r["lang"] for r in got) == ["aa"] * 10 + ["zz"] * 5
    assert all([len(w) for w in r["windows"]] == ([64, 64] if r["lang"] == "aa" else [7]) for r in got)
    assert len({bytes(w[:1]) for r in got if r["lang"] == "aa" for w in r["windows"]}) > 4
    assert len(langid.training_windows(df, 10, 6, 64, 2, 1).collect()) == 6


def test_language_id(spark, corpus):
    df = spark.createDataFrame(corpus, DOCS)
    out = langid.identify(df, steps=80).collect()
    assert len(out) == len(corpus)
    truth = {r[0]: r[2] for r in corpus}
    held = [r for r in out if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 160]
    assert held and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.9 * len(held)
    none = {r["doc_id"]: r for r in out if r["doc_id"] in (1000, 1001, 1002)}
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in none.values()) and len(none) == 3
    assert all(0 <= r["score"] <= 1 for r in out)
    kept = langid.keep_identified(df, steps=80)
    assert kept.columns == df.columns and kept.filter("doc_id >= 1000").count() == 0
    empty = langid.identify(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "held_out", "lang_pred", "score"]


def brute_repeats(rows, k):
    first = {}
    for i, text in rows:
        w = (text or "").encode().split()
        for j in range(len(w) - k + 1):
            key = tuple(w[j : j + k])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, text in rows:
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if first[tuple(w[j : j + k])] < i:
                gone[j : j + k] = [True] * k
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_packed_ids_come_back():
    for v in ([], [5], [-3, 2**40, 7, -3], [2**63 - 1, 0, -(2**63)], [9] * 4):
        v = np.array(v, np.int64)
        assert (substring.unpack(substring.pack(v)) == v).all()


@pytest.mark.parametrize("block_bytes", [300, 5 << 20])
def test_substring_dedup_equals_brute_force(spark, block_bytes):
    rng = random.Random(7)
    shared = [words(rng, "abcd", 20) for _ in range(3)]
    rows = [(i, " ".join(rng.choice([words(rng, "abc", 3), rng.choice(shared), "x  y\tz\n"]) for _ in range(rng.randint(0, 4)))) for i in rng.sample(range(500), 60)]
    rows += [(7000, None), (7001, ""), (7002, shared[0] + " " + shared[0]), (rows[3][0], rows[3][1])]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, block int")
    out = substring.remove_repeats(df, window=5, block_bytes=block_bytes).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out) == brute_repeats(rows, 5)
    for r in out:
        assert sum(s["end"] - s["start"] for s in r["intervals"]) == r["n_removed"]
        assert hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"]


def test_substring_dedup_of_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    assert [r["n_removed"] for r in substring.remove_repeats(df, window=3).collect()] == [0, 0]
    assert substring.remove_repeats(df.limit(0)).count() == 0


def test_feistel_is_a_permutation():
    for size in (1, 2, 7, 100, 1000):
        f = pii.Feistel(b"k", "t", size)
        image = [f.forward(i) for i in range(size)]
        assert sorted(image) == list(range(size)) and [f.backward(i) for i in image] == list(range(size))


KEY = b"a key of the tests"
VALUES = ["4539578763621486", "4539 5787 6362 1486", "+1 (243) 555-5526", "078-05-1120", "10.20.30.40", "2021-02-28", "31/12/1999", "05/06/2003", "28.02.2020", "GB82 WEST 1234 5698 7654 32", "jane.doe7@mail.example.com", "+44 20 7946 0958"]


@pytest.mark.parametrize("value", VALUES)
def test_pseudonyms_keep_format_and_invert(value):
    there, back = pii.Masker(KEY), pii.Masker(KEY, "backward")
    text = f"see {value}, and {value}{',' if value[0] == '+' else ''} 12."
    new, spans = there(text)
    assert value not in new and len(new) >= len(text) - 12 and len(spans) == 2
    got = [new[s : s + n].removesuffix(" 12") for _, s, n in spans]
    assert got[0] == got[1]
    if "." not in value or "@" in value:
        assert [c.isdigit() for c in got[0]] == [c.isdigit() for c in value]
    assert back(new)[0] == text
    assert there(got[0])[1], "a pseudonym is valid itself"


def test_equal_cards_stay_linked_over_layouts_and_decoys_stay():
    m = pii.Masker(KEY)
    assert m("4539578763621486")[0] == m("4539 5787 6362 1486")[0].replace(" ", "")
    for clean in ("4539578763621487", "999.1.2.3", "000-12-3456", "2021-02-30", "version 1.2.3", "3.14159 and 42", "GB83 WEST 1234 5698 7654 32"):
        assert m(clean) == (clean, [])


def test_equal_values_stay_linked_over_layouts():
    m = pii.Masker(KEY)
    digits = lambda t: "".join(c for c in m(t)[0] if c.isdigit())
    phones = ["+1 243 555 5526", "+12435555526", "(243) 555-5526", "243-555-5526", "+1-243-555-5526"]
    assert len({digits(p)[-10:] for p in phones}) == 1 and all(digits(p).startswith("1") for p in phones if p[0] == "+")
    assert digits("+44 20 7946 0958") == digits("+442079460958") and digits("+442079460958").startswith("44")
    assert digits("+351 21 123 4567") == digits("+351211234567")
    for y, mo, d in [(2021, 2, 28), (1999, 12, 31), (2003, 6, 5), (2024, 2, 29)]:
        iso = m(f"{y}-{mo:02d}-{d:02d}")[0].split("-")
        assert m(f"{d:02d}/{mo:02d}/{y}")[0].split("/") == iso[::-1] and m(f"{d:02d}.{mo:02d}.{y}")[0].split(".") == iso[::-1]
        if d > 12:
            assert m(f"{mo:02d}/{d:02d}/{y}")[0].split("/") == [iso[1], iso[2], iso[0]]
    back = pii.Masker(KEY, "backward")
    for t in ("12/31/1999", "a" * 60 + "@x.org", "zz" * 30 + "99@x.org", "+12435555526", "243-155-5526"):
        assert m(t)[0] != t and back(m(t)[0])[0] == t


def brute_feistel(key, tweak, size, x):
    """Independent of the module: the network as its description states it."""
    import hmac

    bits = 2 * max(1, -(-(size - 1).bit_length() // 2))
    root = hmac.new(key, f"{tweak}:{size}".encode(), "sha256").digest()
    while True:
        left, right = divmod(x, 1 << bits // 2)
        for i in range(8):
            mac = hashlib.blake2b(right.to_bytes(16, "little"), key=root + bytes([i]), digest_size=16).digest()
            left, right = right, left ^ int.from_bytes(mac, "little") % (1 << bits // 2)
        x = right * (1 << bits // 2) + left
        if x < size:
            return x


def test_pseudonymised_table_equals_brute_force(spark):
    import ipaddress
    import re

    rng = random.Random(2)
    ip = lambda: str(ipaddress.IPv4Address(rng.randint(0, 2**32 - 1)))
    ssn = lambda: f"{rng.choice([1, 7, 665, 667, 899]):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}"
    texts = [words(rng, "abc", 4) + "".join(f" {rng.choice([ip, ssn])()} {words(rng, 'xyz', 2)}," for _ in range(rng.randint(0, 5))) for _ in range(80)]
    texts += ["", None, texts[0], " ".join(["word 10.0.0.1"] * 50_000)]

    def new_ip(m):
        return str(ipaddress.IPv4Address(brute_feistel(KEY, "ip", 1 << 32, int(ipaddress.IPv4Address(m[0])))))

    def new_ssn(m):
        a, b, c = map(int, m[0].split("-"))
        areas = [i for i in range(1, 900) if i != 666]
        x = brute_feistel(KEY, "ssn", 898 * 99 * 9999, (areas.index(a) * 99 + b - 1) * 9999 + c - 1)
        return f"{areas[x // 9999 // 99]:03d}-{x // 9999 % 99 + 1:02d}-{x % 9999 + 1:04d}"

    def brute(t):
        return None if t is None else re.sub(r"\d+-\d+-\d+", new_ssn, re.sub(r"\d+\.\d+\.\d+\.\d+", new_ip, t))

    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kind string").repartition(3)
    assert {r["doc_id"]: r["text"] for r in pii.pseudonymise(df, KEY).collect()} == {i: brute(t) for i, t in enumerate(texts)}


def test_session_key_is_the_named_one_or_random(spark):
    assert pii.session_key(spark) != pii.session_key(spark)
    spark.conf.set("spark.corpuslens.pii.key", "named")
    assert pii.session_key(spark) == b"named"
    spark.conf.unset("spark.corpuslens.pii.key")


def test_pseudonymised_table(spark):
    df = spark.createDataFrame([(1, "ip 10.20.30.40", "a", 14), (2, None, None, None), (3, "", "b", 0)], "doc_id long, text string, pii_spans string, n_chars long")
    out = {r["doc_id"]: r for r in pii.pseudonymise(df, KEY).collect()}
    assert out[2]["text"] is None and out[3]["text"] == "" and len(out[1]["pii_spans"]) == 1
    docs = pii.pseudonymise_documents(df.drop("pii_spans"), KEY)
    assert docs.columns == ["doc_id", "text", "n_chars"] and docs.filter("n_chars <> length(text)").count() == 0
    assert pii.pseudonymise(df.limit(0), KEY).count() == 0


def labelled_corpus():
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        text = words(rng, "abcdefghij", rng.randint(10, 40))
        good, toxic = i % 3 > 0, i % 4 == 0
        if not good:
            text = " | ".join(t + "###" for t in text.split())
        if toxic:
            text += " " + rng.choice(["zzidiot", "zzscum,", "ZZTRASH!"]) + " " + words(rng, "abcdefghij", 3)
        rows.append((i, text))
        labels.append((i, int(good), int(toxic)))
    labels += [(1, None, None), (None, 1, 1), (9999, 1, 0)]
    return rows + [(5000, None), (5001, ""), (None, "abc")], labels


@pytest.mark.parametrize(("module", "column", "modulus", "remainder"), [(quality, "quality", 4, 2), (toxicity, "toxic", 3, 1)])
def test_linear_classifiers(spark, module, column, modulus, remainder):
    import zlib

    rows, labels = labelled_corpus()
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in module.score(docs, marks).collect()}
    assert len(out) == len(rows)
    truth = {i: (q, t)[column == "toxic"] for i, q, t in labels if i is not None and i < 400 and q is not None}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % modulus == remainder]
    assert all(out[i]["held_out"] for i in held)
    assert sum(out[i]["predicted"] == truth[i] for i in held) >= 0.9 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out.values())
    again = {r["doc_id"]: r["score"] for r in module.score(docs.repartition(5), marks.repartition(3)).collect()}
    assert all(abs(again[i] - out[i]["score"]) < 1e-6 for i in again)
    assert {r["score"] for r in module.score(docs, marks.limit(0)).collect()} == {0.5}
    assert module.score(docs.limit(0), marks).count() == 0
