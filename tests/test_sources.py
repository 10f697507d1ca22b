"""Providers, the wiki source, JSON lines, policies and configuration, Unicode forms."""

import random
from dataclasses import dataclass, field
from unicodedata import normalize

import pytest
from pyspark.sql import functions as F

from corpuslens.functions import text as fn
from corpuslens.operators import quality
from corpuslens.sources import jsonl, policy, providers, shared, wiki


def test_unicode_forms(spark):
    nfd = normalize("NFD", "«não, coração» casa-2 ĀČŐ 12")
    df = spark.createDataFrame([(nfd,), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(fn.words("t")).collect()] == [["não", "coração", "casa", "ĀČŐ"][:2] + ["ĀČŐ"], None, []]
    assert [r[0] for r in df.select(fn.strip_accents(F.lit("āčő Ñ ç ṩ"))).collect()] == ["aco N c s"] * 3
    assert df.select(fn.only_accent_missing(F.lit("circulos"), F.lit(normalize("NFD", "círculos")))).first()[0]
    assert quality.rates(normalize("NFC", "não"), normalize("NFD", "não")) == (0, 0, 0, 0)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_edit_distance_equals_the_table():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 80))] for _ in range(2))
        assert quality.edit_distance(a, b) == plain_distance(a, b)
    many = [f"w{i}" for i in range(70_000)]
    assert quality.edit_distance(many[:3000], many[5:3000] + ["x"] * 7) == 12


def test_providers(spark):
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise providers.ProviderError("busy", 503)
        return x

    waited = []
    assert providers.retried(flaky, wait=waited.append)(1) == 1 and waited == [0.5, 1.0]

    def broken(x):
        raise providers.ProviderError("gone", 404)

    with pytest.raises(providers.ProviderError, match="gone"):
        providers.retried(broken, wait=waited.append)(1)
    assert len(waited) == 2
    df = spark.createDataFrame([("a",), ("bb",), (None,)], "t string")
    embed = providers.embedder(lambda ts: [[len(t), 1] for t in ts], 2, size=2)
    assert [r[0] for r in df.select(embed("t")).collect()] == [[1, 1], [2, 1], [0, 1]]
    short = providers.embedder(lambda ts: [[1.0, 2.0]] * (len(ts) - 1), 2)
    with pytest.raises(Exception, match="vectors came back"):
        df.coalesce(1).select(short("t")).collect()

    def say(p):
        if p == "a":
            raise providers.ProviderError("no")
        yield from p

    assert [r[0] for r in df.select(providers.generator(say)("t")).collect()] == [None, "bb", None]
    words = spark.createDataFrame([("por", "casa"), ("por", "qq"), ("xxx", "a"), ("por", "qq")], "idioma string, palavra string")
    known = providers.unknown_words(words, lambda ws, language: {"qq"} & set(ws) if language == "por" else None)
    assert sorted(map(tuple, known.collect()), key=str) == [("por", "casa", True), ("por", "qq", False), ("xxx", "a", None)]
    listed = providers.suggestions(words, lambda ws, language: {w: [w + "1", w + "2"] for w in ws if w == "qq"})
    assert sorted(map(tuple, listed.collect())) == [("por", "qq", "qq1", 0), ("por", "qq", "qq2", 1)]
    assert providers.hunspell_unknown(["a"], "zzz") is None and providers.hunspell_suggestions([], "zzz") is None


def test_recognition_with_a_reserve(spark):
    df = spark.createDataFrame([("f", bytearray(b"x"), i, "por") for i in (1, 2, 3)], "path string, content binary, pagina int, idioma string")

    def engine(content, page, language):
        if page == 3:
            raise providers.ProviderError("unreadable")
        return "texto longo" if page == 1 else "t"

    got = providers.recognise(df, engine, lambda *a: "reserva lida" if a[1] == 2 else "", least=5).collect()
    assert sorted((r["pagina"], r["texto"], r["motor"]) for r in got) == [(1, "texto longo", "principal"), (2, "reserva lida", "reserva"), (3, None, None)]
    cat = spark.createDataFrame([("f", bytearray(b"um\x0cdois\x0c"), 2), ("g", bytearray(b"a"), None)], "path string, content binary, paginas int")
    assert sorted(map(tuple, providers.text_layers(cat, ("cat",)).collect())) == [("f", 1, "um"), ("f", 2, "dois"), ("g", 1, "a")]
    with pytest.raises(Exception, match="2 pieces for 3 pages"):
        providers.text_layers(cat.withColumn("paginas", F.lit(3)).filter("path = 'f'"), ("cat",)).collect()


PAGES = {f"P {i}": ("#REDIRECT [[x]]" if i == 3 else "curto" if i == 4 else f"texto<ref>nota</ref> da página {i} " + "x" * 90) for i in range(7)}


def fake_wiki():
    """A function of a function travels to the workers by value."""

    def fetch(url, asked):
        if asked.get("meta"):
            return {"query": {"namespaces": {"0": {"*": ""}, "12": {"*": "Lore", "canonical": "L"}}}}
        if asked.get("list"):
            assert asked["apnamespace"] == 12 and asked["apfilterredir"] == "nonredirects"
            at = int(asked.get("apcontinue", 0))
            listed = [{"title": t} for t in sorted(PAGES)][at : at + min(3, asked["aplimit"])]
            more = at + 3 < len(PAGES)
            return {"query": {"allpages": listed}} | ({"continue": {"apcontinue": str(at + 3)}} if more else {})
        wanted = asked["titles"].split("|")
        if "P 6" in wanted:
            raise providers.ProviderError("gone", 404)
        return {"query": {"pages": {str(i): {"title": t} | ({"revisions": [{"slots": {"main": {"*": PAGES[t]}}}]} if t != "P 5" else {}) for i, t in enumerate(wanted)}}}

    return fetch


def test_wiki(spark):
    fetch = fake_wiki()
    assert list(wiki.titles(fetch, "u", 12, 5)) == [f"P {i}" for i in range(5)]
    with pytest.raises(providers.ProviderError, match="no namespace"):
        wiki.namespace_id(fetch, "u", "Other")
    present = spark.createDataFrame([("P_0.txt",)], "documento_origem string")
    got, failed = wiki.download(spark, present, fetch=fetch, url="u", namespace="Lore", limit="6", batch="2")
    rows = {r["titulo_pagina"]: r for r in got.collect()}
    assert sorted(rows) == ["P 1", "P 2"] and rows["P 1"]["corpo"].startswith("texto da página 1") and rows["P 1"]["conteudo"].startswith("# P 1\n\ntexto") and rows["P 1"]["documento_origem"] == "P_1.txt"
    assert failed.count() == 0
    _, failed = wiki.download(spark, present, fetch=fetch, url="u", namespace="Lore", limit="7", batch="1")
    assert [tuple(r) for r in failed.collect()] == [("P 6", "gone")]
    reader = wiki.Reader({"url": "u", "namespace": "L", "limit": "7", "batch": "3", "skip": '["P 0"]'}, fetch)
    parts = reader.partitions()
    assert [p.wanted for p in parts] == [["P 1", "P 2", "P 3"], ["P 4", "P 5", "P 6"]]
    assert len(list(reader.read(parts[0]))) == 3 and [r[2] for r in reader.read(parts[1])] == ["gone"]
    assert wiki.source(fetch).name() == "wiki"


def test_json_lines(spark, tmp_path):
    rows = [("a::0", "t", "a", "T", 0, 0, "", 0, 0, "", "interno"), ("a::1", "u", "a", "T", 1, 4, "s", 1, 2, "v", "")]
    df = spark.createDataFrame(rows, jsonl.CHUNK)
    jsonl.write_chunks(df, f"{tmp_path}/c")
    raw = sorted(r[0] for r in spark.read.text(f"{tmp_path}/c").collect())
    assert '"secao"' not in raw[0] and '"secao":"s"' in raw[1]
    assert sorted(map(tuple, jsonl.read_chunks(spark, f"{tmp_path}/c").collect())) == rows
    (tmp_path / "bad.jsonl").write_text('{"chunk_id":"a","texto":"t"}\n{"chunk_id":\n')
    with pytest.raises(jsonl.InputError, match="line 2"):
        jsonl.read_chunks(spark, f"{tmp_path}/bad.jsonl")
    case = '{"id":"1","demanda":"d","paginas_esperadas":["p"]}\n'
    (tmp_path / "g.jsonl").write_text(case)
    assert jsonl.read_cases(spark, f"{tmp_path}/g.jsonl").first()["paginas_esperadas"] == ["p"]
    for text, why in ((case + "\n" + case, "line 3: id repetido"), (case + '{"id":"2"}', "line 2: campo ausente"), ("{", "line 1: JSON inv"), ("\n", "no case")):
        (tmp_path / "g.jsonl").write_text(text)
        with pytest.raises(jsonl.InputError, match=why):
            jsonl.read_cases(spark, f"{tmp_path}/g.jsonl")


@dataclass
class Search:
    k: int = 8
    share: float = 0.9
    hybrid: bool = True
    name: str = "x"


@dataclass
class Config:
    search: Search = field(default_factory=Search)


def test_policies_and_configuration():
    text = "﻿---\nNome: n\n# nota\nversao: 1\nproblematizar: não\n---\n## Orientação Geral\ntexto\n"
    p = policy.read_policy(text)
    assert p.metadata["nome"] == "n" and not policy.may_problematise(True, p) and policy.may_problematise(True, None) and not policy.may_problematise(False, None)
    with pytest.raises(policy.PolicyError, match="line 3"):
        policy.read_policy(text.replace("# nota", "sem dois pontos"))
    c = Config()
    warnings, origin = policy.layered(c, ("file", {"search": {"k": "5", "odd": 1}, "none": {}}), ("env", policy.from_environment(c, "CL", {"CL_SEARCH_HYBRID": "nao", "CL_SEARCH_K": "6"})))
    assert (c.search.k, c.search.hybrid) == (6, False) and origin == {"search.k": "env", "search.hybrid": "env"}
    assert warnings == ["file: unknown field: search.odd", "file: unknown section: none"]
    assert policy.write_config(c) == "[search]\nk = 6\nhybrid = false\n"
    d = Config()
    assert policy.read_config(d, policy.write_config(c)) == [] and d == c
    assert policy.write_config(Config(), everything=True) == '[search]\nk = 8\nshare = 0.9\nhybrid = true\nname = "x"\n'
    for value, name in ((True, "k"), ("x", "share"), ("talvez", "hybrid")):
        with pytest.raises(ValueError, match=f"search.{name}"):
            policy.apply_config(Config(), {"search": {name: value}})


def test_shared_folder_is_the_sessions(spark):
    folder, made = spark.conf.get("spark.checkpoint.dir"), []
    assert shared.shared_folder(spark) == folder
    df = shared.cut(spark.range(3), made)
    assert df.count() == 3 and made[0].startswith(folder)
    paths = list(made)
    shared.remove(spark, made)
    assert made == [] and not spark._jvm.java.io.File(paths[0]).exists()
