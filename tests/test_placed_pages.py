"""The queries over positioned pages against brute force, on pages with short, empty and long lines."""

import hashlib
import re

from corpuslens.plans import queries

LONG = " ".join(["abcdefghij"] * 20 + ["ab"] * 30)
TEXTS = {
    1: "uma linha comprida\noutra linha comprida",
    2: "um parágrafo\n\noutro parágrafo\nx\nmais texto aqui",
    3: "- 12 -\n\n\n",
    4: "a\nb\n3",
    5: "texto um\ntexto dois\ntexto três\ntexto quatro\ntexto cinco\ntexto seis\nsétima some\ntexto oito\n 7 \n\n¬",
    6: "",
    7: None,
    8: LONG + "\n" + "abcd efgh",
    9: "\n".join(["E", "D2", "ok¬", "4"] * 3),
}


def useful(t):
    return sum(c.isalnum() for c in t)


def kept_lines(text):
    """Lines by block, without those the noise rules take: a block is four lines, each seventh line of the page is '3 o' in the margin."""
    lines = [("3 o" if i % 7 == 6 else t, i % 7 == 6) for i, t in enumerate(text.split("\n"))]
    for a in range(0, len(lines), 4):
        block = lines[a : a + 4]
        full = [t for t, _ in block if t.strip()]
        if len(full) == 1 and re.fullmatch(r"\W*\d{1,4}\W*", full[0]):
            yield [t for t, _ in block]
        elif len(full) >= 3 and all(useful(t) <= 3 for t in full):
            continue
        else:
            yield [t for t, margin in block if not margin]


def derived(text):
    blocks = ["\n".join(t.replace("¬", "-") for t in b if t.strip()) for b in kept_lines(text)]
    return "\n\n".join(b for b in blocks if b)


def words(text):
    return [[len(w) * 37 % 100 / 100 for w in t.split(" ")] for b in kept_lines(text) for t in b]


def documents(spark, tmp_path):
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_derived_text_of_every_document(spark, tmp_path):
    got = {r["doc_id"]: r["texto"] for r in queries.o2_o5_derived_text(spark, documents(spark, tmp_path)).collect()}
    assert got == {i: None if t is None else hashlib.md5(derived(t).encode()).hexdigest() for i, t in TEXTS.items()}


def test_every_word_counts_in_page_marks(spark, tmp_path):
    got = {r["doc_id"]: r for r in queries.o3_o31_page_marks(spark, documents(spark, tmp_path)).collect()}
    assert got.keys() == TEXTS.keys()
    for i in (1, 2, 5, 8):
        by_line = words(TEXTS[i])
        v = [x for line in by_line for x in line]
        assert got[i]["confianca"] == round(sum(v) / len(v), 6)
        assert got[i]["hesitante"] == round(sum(x < 0.5 for x in v) / len(v), 6)
        assert got[i]["linhas"] == sum(sum(line) / len(line) < 0.5 for line in by_line)
