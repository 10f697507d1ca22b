"""Golden cases of the library's operators."""

import math

import pytest
from pyspark.sql import functions as F

from corpuslens.functions import text as fn
from corpuslens.operators import chunking, dialogue, evaluation, lexical, normalise, prompting, quality, ranking, regions
from corpuslens.sources import policy


def one(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_passages(spark):
    p = ["a" * 50, "b" * 50, "c" * 50]
    short, giant = "x" * 10, "palavra " * 200
    assert chunking.by_paragraph("\n\n".join(p), 20, 200) == p and chunking.by_paragraph("\n\n".join([short] * 3), 20, 200) == []
    assert chunking.grouped("\n\n".join(p), 20, 200) == ["\n\n".join(p)] and chunking.grouped("\n\n".join([short] * 3), 20, 200) == ["\n\n".join([short] * 3)]
    pieces = chunking.split_giant(giant, 50)
    assert all(len(x) <= 50 for x in pieces) and " ".join(pieces).split() == giant.split()
    assert chunking.split_giant("x" * 500, 100) == ["x" * 100] * 5
    assert chunking.grouped("a" * 30 + "\n\n" + "b" * 300 + "\n\n" + "c" * 30, 20, 200) == ["a" * 30, "b" * 200, "b" * 100, "c" * 30]
    df = spark.createDataFrame([("d.txt", "T", "\n\n".join(p)), ("e.txt", "T", None), (None, None, p[0])], "documento_origem string, titulo_pagina string, corpo string")
    got = [(r["chunk_id"], r["chunk_index"]) for r in chunking.chunks(df, least=20, most=60).collect()]
    assert got == [("d.txt::0", 0), ("d.txt::1", 1), ("d.txt::2", 2), ("0", 0)]
    with pytest.raises(ValueError):
        chunking.chunks(df, "other")


def test_bm25_by_hand(spark):
    df = spark.createDataFrame([("a", "a1 b1 b1"), ("b", "a1 c1")], "chunk_id string, texto string")
    q = spark.createDataFrame([(1, "B1 zz"), (2, "nada")], "consulta_id long, texto string")
    got = lexical.search(lexical.build(df), q).collect()
    assert len(got) == 1 and got[0]["chunk_id"] == "a" and abs(got[0]["score"] - math.log(2) * 5 / (2 + 1.5 * 1.15)) < 1e-9


def ranked(spark, rows):
    return spark.createDataFrame(rows, "consulta_id long, posicao int, chunk_id string, score double")


def test_fusion_and_policies(spark):
    a = ranked(spark, [(1, 1, "a", 0.99), (1, 2, "b", 0.5)]).unionByName(ranked(spark, [(1, 1, "c", 0.98), (1, 2, "b", 0.5)]))
    assert [r["chunk_id"] for r in ranking.fuse(a).orderBy("posicao").collect()] == ["b", "a", "c"]
    s = ranked(spark, [(1, i + 1, f"c{i}", v) for i, v in enumerate((1.0, 0.95, 0.6, 0.5, 0.4, 0.3))])
    assert ranking.relative_cut(s, 0.9, 2).count() == 2 and ranking.relative_cut(s, 0.9, 5).count() == 5
    assert ranking.decide_quantity(s, 3).count() == 3
    dense = ranked(spark, [(1, 1, "x", 0.7), (1, 2, "y", 0.5)])
    lex = ranked(spark, [(1, 1, "p", 10.0), (1, 2, "q", 6.0), (1, 3, "r", 2.0)])
    assert [round(r["score"], 6) for r in ranking.rescale(lex, dense).orderBy("posicao").collect()] == [0.7, 0.6, 0.5]


def test_budget_keeps_a_prefix(spark):
    size = lambda tokens: "x" * (tokens * 4 - 17)
    rows = [(1, i + 1, "t", size(n)) for i, n in enumerate((100, 100, 500, 10))]
    df = spark.createDataFrame(rows, "consulta_id long, posicao int, titulo_pagina string, texto string")
    assert [r["posicao"] for r in prompting.fit_budget(df, 250).orderBy("posicao").collect()] == [1, 2]
    assert prompting.fit_budget(df, 10).count() == 1


def test_reading_model_output(spark):
    out = "1. alfa beta\n2) gama delta\n- zeta eta\nGAMA delta\nok"
    assert one(spark, [(out,)], "t string", dialogue.sub_questions(F.col("t"), F.lit("quem?"))) == [["alfa beta", "gama delta", "zeta eta"]]
    assert one(spark, [('-> pergunta: "quem?"',)], "t string", dialogue.rewritten(F.col("t"), F.lit("e ele?"))) == ["quem?"]
    assert one(spark, [("x [Fonte 1: a, Fonte 9: b] Fonte 0",)], "t string", prompting.invalid_citations(F.col("t"), 3)) == [["Fonte 9", "Fonte 0"]]
    assert one(spark, [("Faça um plano",), ("O que é isto?",), ("ola",)], "t string", dialogue.kind_by_cues("t")) == ["produto_acabado", "duvida_factual", "indefinido"]


def test_retrieval_measures(spark):
    gold = spark.createDataFrame([(1, "f", "A"), (2, "f", "B"), (3, "f", "C")], "consulta_id long, tipo string, pagina string")
    hits = spark.createDataFrame([(1, 1, "A"), (2, 1, "X"), (2, 2, "B"), (3, 1, "X"), (3, 2, "Y")], "consulta_id long, posicao int, titulo_pagina string")
    s = evaluation.summary(evaluation.cases(gold, hits)).first()
    assert abs(s["recall"] - 2 / 3) < 1e-9 and abs(s["mrr"] - 0.5) < 1e-9


def test_error_rates(spark):
    rows = [("p", "m", "kitten", "sitting"), ("q", "m", "um dois tres quatro", "tres quatro um dois"), ("r", "m", "Ana,quer", "Ana, quer"), ("s", "m", "texto", ""), ("t", "m", "", ""), ("u", "m", "", "x"), ("v", "m", "mês", "mes")]
    got = {r["pagina"]: r for r in quality.error_rates(spark.createDataFrame(rows, "pagina string, motor string, referencia string, candidato string")).collect()}
    assert abs(got["p"]["cer"] - 0.5) < 1e-9
    assert got["q"]["wer"] > 0.5 and got["q"]["wer_sem_ordem"] == 0
    assert got["r"]["wer"] > 0 and got["r"]["wer_pontuacao_separada"] == 0
    assert (got["s"]["cer"], got["t"]["cer"], got["u"]["cer"]) == (1, 0, 1)
    assert abs(got["v"]["cer"] - 1 / 3) < 1e-9


def test_broken_words(spark):
    pages = spark.createDataFrame([(1, "por", "la¬\nranja"), (2, "por", "vendo¬\nse"), (3, "por", "la-\nranja"), (4, "por", "guarda-\nchuva"), (5, "por", "laran\nja"), (6, "xxx", "la-\nranja"), (7, "por", "casa.Ela foi,sim"), (8, "por", "3.5 U.S.A. x@y.org www.y.org Ph.D.")], "pagina long, idioma string, texto string")
    d = spark.createDataFrame([("por", w) for w in ("laranja", "vendo", "se", "guarda", "chuva")], "idioma string, palavra string")
    got = {r["pagina"]: r for r in normalise.pages_text(pages, d).collect()}
    assert [got[i]["texto"] for i in range(1, 9)] == ["laranja", "vendo-se", "laranja", "guarda-chuva", "laranja", "la-ranja", "casa. Ela foi, sim", "3.5 U.S.A. x@y.org www.y.org Ph.D."]
    assert got[5]["regras"] == {"sem_hifen": 1} and got[7]["regras"] == {"pontuacao": 2}


def page(lines, kind="texto"):
    out = []
    for i, (t, x0, y0, x1, y1) in enumerate(lines):
        out.append((f"l{i}", t, [(x0, y0), (x1, y1)], [], [], None))
    return (1, 1000, 2000, "", [("r", kind, [], out)])


def test_regions(spark):
    schema = "doc long, " + regions.PAGE
    rows = [page([(t, 100, 100, 200, 130) for t in ("E", "3", "D2")]), page([("-2-", 500, 50, 540, 80)]), page([("um texto comprido", 100, 100, 900, 130), ("x", 10, 140, 60, 170)])]
    got = [[r["tipo"] for r in x[0]] for x in regions.mark_noise(spark.createDataFrame(rows, schema)).select("regioes").collect()]
    assert got == [["ruido"], ["numero_de_pagina"], ["texto", "ruido"]]
    body = [(f"linha do texto {i}", 100, 200 + i * 40, 900, 230 + i * 40) for i in range(3)]
    stamp = [("Instituto de Pesquisa", 600, 1800, 900, 1830), ("Arquivo Geral", 600, 1840, 900, 1870)]
    marked = regions.split_stamps(spark.createDataFrame([page(body + stamp)], schema), ["INSTITUTO DE PESQUISA", "arquivo gera1"])
    x = marked.select("regioes", regions.derived_text("regioes").alias("t")).first()
    assert [r["id"] for r in x["regioes"]] == ["r", "r_carimbo"] and x["t"].count("\n") == 2


def test_levels(spark):
    def level(share, words=30, characters=100, origin="ocr", hesitant=None):
        return spark.range(1).select(quality.level(F.lit(origin), F.lit(characters), F.lit(words), F.lit(share).cast("double"), F.lit(hesitant).cast("double"))).first()[0]

    assert [level(0.03), level(0.10), level(0.11), level(0.02, hesitant=0.11), level(None), level(0.0, characters=0), level(0.5, origin="digital_nativo")] == ["bom", "regular", "ruim", "regular", "sem medida", "ruim", "texto original"]


def test_policy_documents():
    text = "---\nnome: n\nversao: 1\n---\n## Orientação Geral\ntexto\n## Extra\nmais"
    p = policy.read_policy(text, required_sections=("orientacao_geral",))
    assert [s[0] for s in p.sections] == ["orientacao_geral", "extra"]
    for broken in ("nome: n", "---\nnome: n\n", text.replace("nome: n\n", ""), text.replace("texto\n", "")):
        with pytest.raises(policy.PolicyError):
            policy.read_policy(broken, required_sections=("orientacao_geral",))


def test_point_id(spark):
    import uuid

    assert one(spark, [("doc.txt::3",)], "t string", fn.point_id("t")) == [str(uuid.uuid5(uuid.NAMESPACE_DNS, "doc.txt::3"))]
