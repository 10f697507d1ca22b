"""The quality report: one row a document with its problems in order of gravity, and the four sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import quality

# Origins and problems as they are worded for readers, and the order of levels from the worst.
ORIGINS = {"digital_nativo": "texto original", "ocr": "OCR", "ocr_anterior": "OCR anterior mantido", "sem_texto": "sem texto"}
WORST_FIRST = ("ruim", "sem medida", "regular", "bom", "texto original")
BEST_FIRST = ("bom", "regular", "ruim", "sem medida", "texto original")
LISTED, EXAMPLES, HESITANT_LINES, SUSPECTS = 12, 3, 3, 10


def _numbers(pages: Column) -> Column:
    """At most twelve page numbers, and a sign that there are more."""
    shown = F.array_join(F.transform(F.slice(pages, 1, LISTED), lambda p: p.cast("string")), ", ")
    return F.when(F.size(pages) > LISTED, F.concat(shown, F.lit(" …"))).otherwise(shown)


def _pages_where(test: Column) -> Column:
    return F.array_sort(F.collect_list(F.when(test, F.col("pagina"))))


def _tally(column: str) -> Column:
    return F.sum(F.coalesce(F.try_element_at("regras", F.lit(column)), F.lit(0)))


def documents(pages: DataFrame, records: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """pages (handle, arquivo, pagina, origem, nivel, idioma_suspeito, palavras, caracteres, fora_do_dicionario, acentos_perdidos, exemplos_de_acento,
    confianca_media, fracao_hesitante, linhas_hesitantes, colunas, regras, suspeitas, escolhido) and records (handle, arquivo, idioma, idioma_detectado,
    ocr_ferramenta, linhas_por_tipo map) -> one row a document. `earlier` has (handle, arquivo, fora_do_dicionario) of another engine."""
    keys = ["handle", "arquivo"]
    o = F.col("origem")
    base = quality.documents(pages).select(*keys, "paginas", "paginas_ocr", "paginas_ocr_anterior", "paginas_originais", "paginas_vazias", "fora_do_dicionario", "pior_pagina", "nivel")
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("n").desc(), "first"))
    suspects = pages.select(*keys, "pagina", F.posexplode("suspeitas").alias("i", "w")).groupBy(*keys, "w").agg(F.count("*").alias("n"), F.min(F.struct("pagina", "i")).alias("first"))
    suspects = suspects.withColumn("k", nth).filter(F.col("k") <= SUSPECTS).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "w"))), lambda x: x["w"]).alias("suspeitas"))
    other = pages.filter(F.coalesce("idioma_suspeito", F.lit("")) != "").groupBy(*keys, "idioma_suspeito").agg(F.count("*").alias("n"), F.min("pagina").alias("p"))
    other = other.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("p")).alias("p"), "idioma_suspeito")).alias("outro"))
    levels = F.array_join(F.filter(F.array(*[F.when(F.count_if(F.col("nivel") == x) > 0, F.concat(F.lit(f"{x}: "), F.count_if(F.col("nivel") == x).cast("string"))) for x in BEST_FIRST]), lambda s: s.isNotNull()), ", ")
    agg = pages.groupBy(*keys).agg(
        _pages_where((F.col("nivel") == "ruim") & ((F.col("caracteres") == 0) | (o == "sem_texto"))).alias("vazias"),
        _pages_where(F.coalesce("colunas", F.lit(False))).alias("em_colunas"),
        _pages_where(F.col("escolhido") == "ocr").alias("substituidas"),
        _pages_where(F.col("escolhido") == "ocr_anterior").alias("mantidas"),
        F.sum(F.coalesce("acentos_perdidos", F.lit(0))).alias("acentos"),
        F.slice(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pagina", F.col("exemplos_de_acento").alias("e")))), lambda x: F.coalesce(x["e"], F.array().cast("array<string>")))), 1, EXAMPLES).alias("exemplos"),
        F.sum(F.coalesce("linhas_hesitantes", F.lit(0))).alias("hesitantes"),
        (F.count_if((F.col("caracteres") > 0) & F.col("fora_do_dicionario").isNotNull()) == 0).alias("sem_dicionario"),
        (F.count_if(o != "digital_nativo") > 0).alias("alguma_lida"),
        (_tally("hifen_marcado") + _tally("hifen_comum") + _tally("sem_hifen")).alias("palavras_juntadas"),
        quality.weighted(F.col("confianca_media"), F.col("palavras")).alias("confianca_media"),
        levels.alias("niveis_das_paginas"),
    )
    j = base.join(agg, keys).join(records, keys).join(suspects, keys, "left").join(other, keys, "left")
    if earlier is not None:
        j = j.join(earlier.select(*keys, F.col("fora_do_dicionario").alias("fora_do_dicionario_anterior")), keys, "left")
    else:
        j = j.withColumn("fora_do_dicionario_anterior", F.lit(None).cast("double"))
    kind = lambda t: F.coalesce(F.try_element_at("linhas_por_tipo", F.lit(t)), F.lit(0))
    j = j.withColumn("linhas_de_carimbo", kind("carimbo")).withColumn("linhas_de_ruido", kind("ruido"))
    return j.select(
        *keys,
        F.concat(F.coalesce("idioma", F.lit("")), F.when(F.coalesce("idioma_detectado", F.lit(False)), F.lit(" (detectado; catálogo sem idioma)")).otherwise(F.lit(""))).alias("idioma"),
        origin().alias("origem"), "paginas", "paginas_ocr", "paginas_ocr_anterior", "paginas_originais", "paginas_vazias", "nivel", "pior_pagina", "niveis_das_paginas", "fora_do_dicionario", "fora_do_dicionario_anterior",
        F.when(~F.col("sem_dicionario"), F.col("acentos")).alias("acentos_perdidos"), "confianca_media", "linhas_de_carimbo", "linhas_de_ruido", "palavras_juntadas",
        problems().alias("problemas"), F.coalesce("suspeitas", F.array().cast("array<string>")).alias("suspeitas"),
    )


def origin() -> Column:
    """What a document's text comes from."""
    tool = F.lower(F.coalesce("ocr_ferramenta", F.lit("")))
    engine = F.when(tool.contains("kraken"), F.lit("Kraken")).when(tool.contains("tesseract"), F.lit("Tesseract")).otherwise(F.lit(""))
    kept, new, ours = F.size("mantidas") > 0, F.size("substituidas") > 0, F.col("paginas_ocr") > 0
    return (
        F.when(kept & ~ours, F.lit("OCR anterior mantido"))
        .when(ours & new & ~kept, F.concat(F.lit("OCR anterior substituído pelo "), engine))
        .when(ours & kept, F.concat(F.lit("misto: "), engine, F.lit(" e OCR anterior")))
        .when(ours & (F.col("paginas_originais") > 0), F.concat(F.lit("misto: texto original e OCR "), engine))
        .when(ours, F.concat(F.lit("OCR "), engine))
        .when(F.col("paginas_originais") > 0, F.lit("texto original (digital)"))
        .otherwise(F.lit("sem texto"))
    )


def problems() -> Column:
    """The problems that a document has, the gravest first; the last two kinds only inform."""
    n = lambda c: F.size(c).cast("string")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    examples = F.when(F.size("exemplos") > 0, text(" (ex.: ", F.array_join("exemplos", "; "), ")")).otherwise(F.lit(""))
    taken = F.array_join(F.filter(F.array(*[F.when(F.col(f"linhas_de_{k}") > 0, text(F.col(f"linhas_de_{k}").cast("string"), f" linha(s) de {k}")) for k in ("carimbo", "ruido")]), lambda s: s.isNotNull()), ", ")
    cases = [
        (F.size("vazias") > 0, text("P1 · ", n("vazias"), " página(s) sem texto: ", _numbers(F.col("vazias")))),
        (F.col("outro").isNotNull(), text("P3 · ", F.col("outro.n").cast("string"), " página(s) leem melhor em ", F.col("outro.idioma_suspeito"), " que em ", F.coalesce(F.nullif("idioma", F.lit("")), F.lit("?")))),
        (F.col("acentos") > 0, text("P2 · ", F.col("acentos").cast("string"), " acento(s) perdido(s)", examples)),
        (F.col("fora_do_dicionario") > quality.REGULAR, text("P2 · ", F.format_string("%.0f%%", F.bround(F.col("fora_do_dicionario") * 100, 0)), " das palavras fora do dicionário")),
        (F.size("em_colunas") > 0, text("P6 · colunas nas páginas ", _numbers(F.col("em_colunas")), ": conferir a ordem de leitura")),
        (F.col("hesitantes") >= HESITANT_LINES, text("P7 · ", F.col("hesitantes").cast("string"), " linha(s) de baixa confiança")),
        (F.col("sem_dicionario") & F.col("alguma_lida"), F.lit("sem dicionário para o idioma: qualidade não medida")),
        (F.size("mantidas") > 0, text("OCR anterior melhor que o Kraken nas páginas ", _numbers(F.col("mantidas")), ": mantido")),
        (F.size("substituidas") > 0, text("OCR anterior substituído pelo Kraken nas páginas ", _numbers(F.col("substituidas")))),
        (F.length(taken) > 0, text("P8 · tirados do texto: ", taken)),
        (F.col("palavras_juntadas") > 0, text("P4 · ", F.col("palavras_juntadas").cast("string"), " palavra(s) partida(s) juntada(s)")),
    ]
    return F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), said) for test, said in cases]), lambda s: s.isNotNull())


def sheets(docs: DataFrame, pages: DataFrame, titles: DataFrame, date: str) -> dict[str, DataFrame]:
    """Resumo, Documentos, Páginas, Legenda. titles: (handle, titulo)."""
    place = F.array_position(F.array(*map(F.lit, WORST_FIRST)), F.col("nivel"))
    documentos = docs.join(titles, "handle", "left").orderBy(place, "handle", "arquivo").select(
        "handle", F.coalesce("titulo", F.lit("")).alias("titulo"), "idioma", "origem", "paginas", "paginas_ocr", "paginas_ocr_anterior", "paginas_originais", "paginas_vazias", "nivel", "pior_pagina", "niveis_das_paginas",
        F.round("fora_do_dicionario", 4).alias("fora_do_dicionario"), F.round("fora_do_dicionario_anterior", 4).alias("fora_do_dicionario_anterior"), "acentos_perdidos", F.round("confianca_media", 4).alias("confianca_media"),
        "linhas_de_carimbo", "linhas_de_ruido", "palavras_juntadas", F.array_join("problemas", "\n").alias("problemas"), F.array_join("suspeitas", ", ").alias("suspeitas"), "arquivo",
    )
    tally = lambda *rules: sum((F.coalesce(F.try_element_at("regras", F.lit(r)), F.lit(0)) for r in rules), F.lit(0))
    label = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ORIGINS.items() for x in kv]), F.col("origem")), F.col("origem"))
    paginas = pages.orderBy("handle", "arquivo", "pagina").select(
        "handle", "arquivo", "pagina", label.alias("origem"), "nivel", F.round("fora_do_dicionario", 4).alias("fora_do_dicionario"), "palavras", "acentos_perdidos", F.round("confianca_media", 4).alias("confianca_media"),
        F.round("fracao_hesitante", 4).alias("palavras_hesitantes"), "linhas_hesitantes", F.when(F.col("colunas"), "sim").otherwise("").alias("colunas"), F.coalesce("idioma_suspeito", F.lit("")).alias("idioma_suspeito"),
        tally("hifen_marcado", "hifen_comum", "sem_hifen").alias("palavras_juntadas"), tally("pontuacao").alias("pontuacao_corrigida"),
        F.when(F.col("escolhido") == "ocr", "Kraken").when(F.col("escolhido") == "ocr_anterior", "anterior").otherwise("").alias("leitura_escolhida"), F.array_join("suspeitas", ", ").alias("suspeitas"),
    )
    return {"Resumo": summary(docs, pages, date), "Documentos": documentos, "Páginas": paginas, "Legenda": legend(docs.sparkSession)}


def summary(docs: DataFrame, pages: DataFrame, date: str) -> DataFrame:
    """(ordem, item, valor): counts of documents and pages, by level and by language."""
    d = docs.agg(F.count("*").alias("n"), *[F.count_if(F.col("nivel") == x).alias(f"d{i}") for i, x in enumerate(BEST_FIRST)])
    p = pages.agg(F.count("*").alias("m"), *[F.count_if(F.col("nivel") == x).alias(f"p{i}") for i, x in enumerate(BEST_FIRST)])
    one = d.withColumn("_", F.lit(1)).join(p.withColumn("_", F.lit(1)), "_")
    row = lambda i, item, value: F.struct(F.lit(i).alias("ordem"), F.lit(item).alias("item"), value.cast("string").alias("valor"))
    good = F.col("p0") + F.col("p4")
    share = F.concat(good.cast("string"), F.lit(" de "), F.col("m").cast("string"), F.lit(" ("), F.format_string("%.0f%%", F.bround(good * 100 / F.greatest("m", F.lit(1)), 0)), F.lit(")"))
    rows = [row(0, "Gerado em", F.lit(date)), row(1, "Documentos (PDFs)", F.col("n")), row(2, "Páginas", F.col("m"))]
    rows += [row(10 + i, f"Documentos: {x}", F.col(f"d{i}")) for i, x in enumerate(BEST_FIRST)] + [row(20 + i, f"Páginas: {x}", F.col(f"p{i}")) for i, x in enumerate(BEST_FIRST)]
    fixed = one.select(F.explode(F.array(*rows, row(30, "Páginas boas ou com texto original", share))).alias("r")).select("r.*").filter((F.col("valor") != "0") | (F.col("ordem") < 10))
    by_language = docs.groupBy(F.coalesce(F.nullif("idioma", F.lit("")), F.lit("(sem)")).alias("i")).agg(F.count("*").alias("n"))
    languages = by_language.select(F.lit(40).alias("ordem"), F.concat(F.lit("Documentos por idioma: "), "i").alias("item"), F.col("n").cast("string").alias("valor"))
    return fixed.unionByName(languages).orderBy("ordem", "item")


def legend(spark) -> DataFrame:
    """What levels and codes mean."""
    levels = {
        "bom": f"até {quality.GOOD:.0%} das palavras de inicial minúscula fora do dicionário", "regular": f"até {quality.REGULAR:.0%} fora do dicionário",
        "ruim": f"mais de {quality.REGULAR:.0%} fora do dicionário, ou página sem texto (P1)", "sem medida": f"sem dicionário para o idioma, ou página com menos de {quality.LEAST_WORDS} palavras",
        "texto original": "texto digital do próprio PDF, sem OCR: não é medido como OCR",
    }
    codes = {
        "P1": "Página perdida: ficou sem texto depois do OCR", "P2": "Reconhecimento: acentos perdidos e palavras fora do dicionário",
        "P3": "Idioma: o texto erra muito menos no dicionário de outro idioma que no do catálogo", "P4": "Palavras partidas no fim da linha, juntadas (informativo: já tratado)",
        "P6": "Ordem de leitura: colunas lado a lado — conferir na imagem se a ordem está certa", "P7": "Linhas de baixa confiança fora do carimbo e do ruído: caneta, carimbo de outro tipo, mancha",
        "P8": "Carimbo e ruído de digitalização tirados do texto (informativo: já tratado)",
    }
    rows = [(i, k, v) for i, (k, v) in enumerate([*levels.items(), *codes.items()])]
    return spark.createDataFrame(rows, "ordem int, codigo string, significado string").orderBy("ordem")


def write_sheets(tables: dict[str, DataFrame], path: str) -> None:
    """One CSV folder a sheet, headed, in its order (a report for readers: each sheet is one file)."""
    for name, df in tables.items():
        df.coalesce(1).write.mode("overwrite").option("header", True).option("multiLine", True).option("escape", '"').csv(f"{path}/{name}")
