"""Positioned pages in PAGE XML, pages of a document, extraction, normalisation and the report."""

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import normalise, quality, regions, report
from corpuslens.plans import stages
from corpuslens.sources import pages

LINE = {"contorno": [{"x": 1, "y": 2}, {"x": 30, "y": 9}], "linha_de_base": [{"x": 1, "y": 8}], "confianca": 0.5}
PAGE = {
    "largura": 100,
    "altura": 200,
    "imagem": "p.png",
    "regioes": [
        {"id": "b", "tipo": "carimbo", "contorno": [{"x": 0, "y": 0}, {"x": 9, "y": 9}], "linhas": [{**LINE, "id": "b0", "texto": "Arquivo", "palavras": [{"texto": "Arquivo", "contorno": [], "confianca": 0.25}]}]},
        {"id": "a", "tipo": "texto", "contorno": [], "linhas": [{**LINE, "id": "a0", "texto": "um & dois", "palavras": [{"texto": "um", "contorno": [{"x": 1, "y": 1}], "confianca": None}]}]},
    ],
}


def test_page_xml_comes_back():
    got = pages.parse(pages.render(PAGE))
    assert (got["largura"], got["altura"], got["imagem"]) == (100, 200, "p.png")
    assert [(r["id"], r["tipo"]) for r in got["regioes"]] == [("b", "carimbo"), ("a", "texto")]
    assert got["regioes"][0] == {**PAGE["regioes"][0], "linhas": [{**PAGE["regioes"][0]["linhas"][0], "palavras": [{"texto": "Arquivo", "contorno": [{"x": 0, "y": 0}], "confianca": 0.25}]}]}
    # A region without an outline gets its lines' rectangle.
    assert got["regioes"][1]["contorno"] == [{"x": 1, "y": 2}, {"x": 30, "y": 2}, {"x": 30, "y": 9}, {"x": 1, "y": 9}]
    assert got["regioes"][1]["linhas"] == PAGE["regioes"][1]["linhas"]
    assert pages.parse(pages.render(got, at="x")) == got


def test_reading_order_and_spellings():
    xml = f"""<PcGts xmlns="{pages.SPACE}"><Page imageWidth="5"><ReadingOrder><OrderedGroup><RegionRefIndexed index="1" regionRef="x"/><RegionRefIndexed index="0" regionRef="z"/></OrderedGroup></ReadingOrder>
    <TextRegion id="w" type="paragraph"/><TextRegion id="x" custom="structure {{type:marginalia;}}"/><TextRegion id="y" custom="readingOrder {{index:0;}} type {{a:b; type:Default;}}"/>
    <TextRegion id="z"><TextLine id="l"><Word><TextEquiv><Unicode> </Unicode></TextEquiv></Word><TextEquiv conf="0.5"><Unicode>t</Unicode></TextEquiv></TextLine></TextRegion></Page></PcGts>"""
    got = pages.parse(xml)["regioes"]
    assert [(r["id"], r["tipo"]) for r in got] == [("z", "texto"), ("x", "marginalia"), ("w", "texto"), ("y", "texto")]
    assert got[0]["linhas"] == [{"id": "l", "texto": "t", "contorno": [], "linha_de_base": [], "palavras": [], "confianca": 0.5}]
    with pytest.raises(pages.PageError):
        pages.parse(f'<PcGts xmlns="{pages.SPACE}"/>')


def test_page_xml_tables_and_texts(spark):
    df = spark.createDataFrame([("um\ndois¬\n\n \n\ntrês",), ("",), (None,)], "texto string").withColumn("n", F.lit(1))
    p = df.filter("texto is not null").select("n", F.lit(0).alias("largura"), F.lit(0).alias("altura"), F.lit("").alias("imagem"), pages.unplaced("texto").alias("regioes"))
    back = pages.read_page_xml(pages.write_page_xml(p))
    assert back.columns == ["n", "largura", "altura", "imagem", "regioes"]
    assert [r[0] for r in back.select(regions.derived_text("regioes")).collect()] == ["um\ndois-\n\ntrês", ""]
    assert [r[0] for r in p.select(normalise.blocks_of_regions("regioes", ("carimbo",))).collect()] == [[["um", "dois¬"], ["três"]], []]
    assert pages.read_page_xml(pages.write_page_xml(p.limit(0))).count() == 0


def test_pages_of_documents(spark):
    docs = spark.createDataFrame([("h", "a\fb\f"), ("i", "c"), ("j", None)], "handle string, texto string")
    p = pages.split_pages(docs)
    assert sorted((r["handle"], r["pagina"], r["texto"]) for r in p.collect()) == [("h", 1, "a"), ("h", 2, "b"), ("h", 3, ""), ("i", 1, "c")]
    assert {r["handle"]: (r["texto"], r["paginas"]) for r in pages.join_pages(p, ["handle"]).collect()} == {"h": ("a\fb\f", 3), "i": ("c", 1)}
    assert docs.select(pages.page_text(F.lit(" é\f x "))).first()[0] == "é\n x"
    v = spark.createDataFrame([(1, "r"), (2, None)], "n long, v string")
    o = spark.createDataFrame([(1, "o"), (2, "o")], "n long, v string")
    got = pages.effective(spark.range(1, 4).toDF("n"), v, o, ["n"], "v")
    assert {r["n"]: r["v"] for r in got.collect()} == {1: "r", 2: "o", 3: None}


def test_transcriptions_and_asked_pages(spark, tmp_path):
    for name, text in (("referencias/p_p0001.txt", "um dois"), ("candidatos/x/p_p0001.txt", "um dos"), ("candidatos/y/q.txt", "z")):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    references, candidates = pages.transcriptions(spark, str(tmp_path))
    grid = quality.candidate_grid(references, candidates, candidates)
    assert sorted((r["motor"], r["candidato"], r["falta"]) for r in grid.collect()) == [("x", "um dos", False), ("y", None, True)]
    files = spark.createDataFrame([("7891/1", "f.x.pdf", "spa")], "handle string, arquivo string, idioma string")
    wanted = spark.createDataFrame([("7891_1_f.x_p0012",), ("7891_1_f.x",), ("8_p1",)], "identificador string")
    got = {r["identificador"]: (r["arquivo"], r["pagina"], r["idioma"], r["falta"]) for r in pages.asked_pages(wanted, files).collect()}
    assert got == {"7891_1_f.x_p0012": ("f.x.pdf", 12, "spa", False), "7891_1_f.x": (None, None, "por", True), "8_p1": (None, 1, "por", True)}


WORDS = "o texto desta página tem palavras conhecidas do dicionário e nada mais que isso aqui agora".split()


def test_extraction(spark):
    good, bad = " ".join(WORDS), " ".join(w[::-1] + "q" for w in WORDS)
    d = spark.createDataFrame([("por", w) for w in WORDS], "idioma string, palavra string")
    layers = [("h", "a.pdf", 1, good, 0.1, "por"), ("h", "a.pdf", 2, "x", 0.1, "por"), ("h", "a.pdf", 3, bad, 0.95, "por"), ("h", "a.pdf", 4, good, 0.95, "por"), ("i", "b.pdf", 1, good, 0.0, "por"), ("j", "c.pdf", 1, None, 0.0, "por")]
    readings = [("h", "a.pdf", 2, good), ("h", "a.pdf", 3, good), ("h", "a.pdf", 4, bad)]
    out, docs = stages.extract(spark.createDataFrame(layers, "handle string, arquivo string, pagina int, texto string, cobertura double, idioma string"), spark.createDataFrame(readings, "handle string, arquivo string, pagina int, lido string"), d)
    got = {(r["handle"], r["pagina"]): (r["texto"], r["origem"], r["escolhido"]) for r in out.collect()}
    assert got == {("h", 1): (good, "digital_nativo", None), ("h", 2): (good, "ocr", None), ("h", 3): (good, "ocr", "ocr"), ("h", 4): (good, "ocr_anterior", "ocr_anterior"), ("i", 1): (good, "digital_nativo", None), ("j", 1): ("", "sem_texto", None)}
    r = {r["handle"]: r for r in docs.collect()}
    assert r["h"]["texto"] == "\f".join([good] * 4) and r["h"]["paginas_ocr"] == [2, 3] and r["h"]["origem_do_texto"] == "ocr"
    assert r["i"]["origem_do_texto"] == "digital_nativo" and r["j"]["paginas_abaixo_do_minimo"] == [1]


def test_normalisation_stage(spark):
    half = " ".join(WORDS[:7])
    text = f"{half} pala¬\nvras,fim\f\f{half}"
    d = spark.createDataFrame([("por", w) for w in [*WORDS, "fim"]], "idioma string, palavra string")
    rows = [("h", "a.pdf", "por", text, ["ocr", "sem_texto", "ocr"]), ("i", "b.pdf", None, " ".join(WORDS), ["ocr"]), ("j", "c.pdf", "", "zzzz", []), ("k", "d.pdf", "por", None, [])]
    ex = spark.createDataFrame(rows, "handle string, arquivo string, idioma string, texto string, origem_por_pagina array<string>")
    docs, rated, aside = stages.normalised(ex, d, spark.createDataFrame([("h", "spa")], "handle string, idioma string"))
    got = {r["handle"]: r for r in docs.collect()}
    assert got["h"]["texto"] == f"{half} palavras, fim\f\f{half}" and got["h"]["paginas"] == 3 and got["h"]["idioma"] == "por"
    assert (got["i"]["idioma"], got["i"]["detectado"], got["j"]["idioma"], got["j"]["detectado"]) == ("por", True, "", False)
    assert [r["motivo"] for r in aside.collect()] == ["sem texto extraído"]
    p = {(r["handle"], r["pagina"]): r for r in rated.collect()}
    assert p["h", 1]["regras"] == {"hifen_marcado": 1, "pontuacao": 1} and p["h", 1]["exemplos"] == {"hifen_marcado": ["pala¬ / vras"], "pontuacao": ["palavras,fim"]}
    assert (p["h", 2]["nivel"], p["i", 1]["nivel"], p["j", 1]["nivel"]) == ("ruim", "sem medida", "sem medida")
    assert sorted((r["handle"], r["aviso"]) for r in stages.warnings(docs).collect()) == [("i", "sem idioma no catálogo; detectado por"), ("j", "sem idioma, sem medida do dicionário")]


PAGES = "handle string, arquivo string, pagina int, origem string, nivel string, idioma_suspeito string, palavras long, caracteres int, fora_do_dicionario double, acentos_perdidos long, exemplos_de_acento array<string>, confianca_media double, fracao_hesitante double, linhas_hesitantes int, colunas boolean, regras map<string,int>, suspeitas array<string>, escolhido string"


def test_report(spark):
    row = lambda h, n, origin, level, **more: (h, f"{h}.pdf", n, origin, level, *({"idioma_suspeito": None, "palavras": 100, "caracteres": 500, "fora": 0.2, "acentos": None, "exemplos": [], "conf": 0.9, "hes": 0.0, "linhas": 0, "colunas": False, "regras": {}, "suspeitas": [], "escolhido": None} | more).values())
    rows = [
        row("h", 1, "ocr", "ruim", idioma_suspeito="spa", acentos=2, exemplos=["a → á", "b → ḃ"], linhas=3, colunas=True, regras={"hifen_marcado": 2, "sem_hifen": 1, "pontuacao": 9}, suspeitas=["qq", "zz"], escolhido="ocr"),
        row("h", 2, "sem_texto", "ruim", caracteres=0, palavras=0, fora=None, suspeitas=["zz"]),
        row("i", 1, "digital_nativo", "texto original", fora=0.5),
        row("j", 1, "ocr_anterior", "sem medida", fora=None, escolhido="ocr_anterior"),
    ]
    records = [("h", "h.pdf", "por", False, "Kraken 5", {"carimbo": 2, "ruido": 1}), ("i", "i.pdf", "", False, "", {}), ("j", "j.pdf", "xxx", True, "tesseract", {})]
    p = spark.createDataFrame(rows, PAGES)
    docs = report.documents(p, spark.createDataFrame(records, "handle string, arquivo string, idioma string, idioma_detectado boolean, ocr_ferramenta string, linhas_por_tipo map<string,int>"), spark.createDataFrame([("h", "h.pdf", 0.3)], "handle string, arquivo string, fora_do_dicionario double"))
    got = {r["handle"]: r for r in docs.collect()}
    assert got["h"]["problemas"] == [
        "P1 · 1 página(s) sem texto: 2", "P3 · 1 página(s) leem melhor em spa que em por", "P2 · 2 acento(s) perdido(s) (ex.: a → á; b → ḃ)", "P2 · 20% das palavras fora do dicionário",
        "P6 · colunas nas páginas 1: conferir a ordem de leitura", "P7 · 3 linha(s) de baixa confiança", "OCR anterior substituído pelo Kraken nas páginas 1", "P8 · tirados do texto: 2 linha(s) de carimbo, 1 linha(s) de ruido", "P4 · 3 palavra(s) partida(s) juntada(s)",
    ]
    assert got["h"]["suspeitas"] == ["zz", "qq"] and got["h"]["origem"] == "OCR anterior substituído pelo Kraken" and got["h"]["fora_do_dicionario_anterior"] == 0.3
    assert (got["i"]["origem"], got["i"]["problemas"], got["i"]["niveis_das_paginas"]) == ("texto original (digital)", [], "texto original: 1")
    assert got["j"]["origem"] == "OCR anterior mantido" and got["j"]["idioma"].startswith("xxx (detectado") and got["j"]["acentos_perdidos"] is None
    assert got["j"]["problemas"] == ["sem dicionário para o idioma: qualidade não medida", "OCR anterior melhor que o Kraken nas páginas 1: mantido"]
    s = report.sheets(docs, p, spark.createDataFrame([("h", "Um título")], "handle string, titulo string"), "hoje")
    assert [(r["handle"], r["titulo"]) for r in s["Documentos"].collect()] == [("h", "Um título"), ("j", ""), ("i", "")]
    assert [(r["palavras_juntadas"], r["pontuacao_corrigida"], r["origem"]) for r in s["Páginas"].collect()][0] == (3, 9, "OCR")
    items = {r["item"]: r["valor"] for r in s["Resumo"].collect()}
    assert items["Documentos (PDFs)"] == "3" and items["Páginas: ruim"] == "2" and items["Páginas boas ou com texto original"] == "1 de 4 (25%)" and items["Documentos por idioma: (sem)"] == "1"
    assert s["Legenda"].count() == 12


def test_report_files(spark, tmp_path):
    report.write_sheets({"Legenda": report.legend(spark)}, str(tmp_path))
    assert spark.read.option("header", True).csv(f"{tmp_path}/Legenda").count() == 12


def test_restriction(spark):
    kept, absent = stages.restricted(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "handle string, n int"), spark.createDataFrame([("a",), ("z",), ("a",)], "handle string"))
    assert sorted(r["n"] for r in kept.collect()) == [1, 2] and [r["handle"] for r in absent.collect()] == ["z"]
