"""The batch stages over an archive: what is extracted from its files, and its normalised text with the quality of every page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import normalise, quality
from ..sources import archive, pages

DOCUMENT = ["handle", "arquivo"]


def restricted(rows: DataFrame, wanted: DataFrame, key: str = "handle") -> tuple[DataFrame, DataFrame]:
    """The rows of the wanted keys, and the wanted keys that no row has (a warning each)."""
    asked = wanted.select(key).distinct()
    return rows.join(asked, key, "left_semi"), asked.join(rows, key, "left_anti")


def share_outside(texts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(page keys, fracao): the share of all words that the dictionary of the page's language lacks; null without words or dictionary."""
    w = quality.known(quality.page_words(texts), dictionary)
    share = F.sum(F.when(F.col("desconhecida"), F.col("n")).when(~F.col("desconhecida"), 0)) / F.sum(F.when(F.col("desconhecida").isNotNull(), F.col("n")))
    return w.groupBy(*quality.PAGE).agg(share.alias("fracao"))


def extract(layers: DataFrame, readings: DataFrame, dictionary: DataFrame, least: int = 50, covered: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """layers (handle, arquivo, pagina, texto, cobertura, idioma) are the files' own text; readings (handle, arquivo, pagina, lido) the recognition of pages
    without text or under a scan. Pages with the text that stays, its origem and the choice made; and one record a document."""
    keys = quality.PAGE
    p = layers.withColumn("texto", pages.page_text("texto")).withColumn("vazia", ~fn.has_text(F.coalesce("texto", F.lit("")), least))
    p = p.withColumn("anterior", ~F.col("vazia") & (F.col("cobertura") >= covered))
    r = p.filter("vazia or anterior").select(*keys, "idioma").join(readings, keys).withColumn("lido", pages.page_text("lido"))
    both = p.filter("anterior").select(*keys, "idioma", "texto")
    old = share_outside(both, dictionary).withColumnRenamed("fracao", "fracao_anterior")
    new = share_outside(r.select(*keys, "idioma", F.col("lido").alias("texto")), dictionary).withColumnRenamed("fracao", "fracao_ocr")
    j = p.join(r.select(*keys, "lido"), keys, "left").join(old, keys, "left").join(new, keys, "left")
    read = F.coalesce("lido", F.lit(""))
    better = fn.has_text(read, least) & F.coalesce(F.col("fracao_ocr") <= F.col("fracao_anterior"), F.lit(True))
    longer = fn.useful_characters(read) > fn.useful_characters(F.coalesce("texto", F.lit("")))
    ours = F.col("lido").isNotNull() & F.when(F.col("anterior"), better).otherwise(longer)
    j = j.withColumn("nosso", ours).withColumn("texto", F.when(F.col("nosso"), F.col("lido")).otherwise(F.coalesce("texto", F.lit(""))))
    j = j.withColumn("origem", archive.origin(F.col("nosso"), "texto", F.col("anterior"), least))
    chosen = F.when(F.col("anterior") & F.col("lido").isNotNull(), F.when(F.col("nosso"), F.lit("ocr")).otherwise(F.lit("ocr_anterior")))
    out = j.select(*keys, "idioma", "texto", "origem", "fracao_anterior", "fracao_ocr", chosen.alias("escolhido"))
    listed = lambda test: F.array_sort(F.collect_list(F.when(test, F.col("pagina"))))
    whole = F.array_sort(F.collect_list(F.struct("pagina", "texto", "origem")))
    g = j.groupBy(*DOCUMENT).agg(
        F.count("*").alias("total_de_paginas"),
        F.array_join(F.transform(whole, lambda x: x["texto"]), pages.PAGE_BREAK).alias("texto"),
        F.transform(whole, lambda x: x["origem"]).alias("origem_por_pagina"),
        F.when(F.count_if("nosso") > 0, "ocr").when(F.count_if("anterior") > 0, "ocr_anterior").otherwise("digital_nativo").alias("origem_do_texto"),
        listed(F.col("nosso")).alias("paginas_ocr"),
        listed(~fn.has_text("texto", least)).alias("paginas_abaixo_do_minimo"),
        F.max("idioma").alias("idioma"),
    )
    return out, g


def normalised(extracted: DataFrame, dictionary: DataFrame, catalogue: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """extracted (handle, arquivo, idioma, texto with page breaks, origem_por_pagina) -> normalised documents with as many pages as before, pages with
    rules, indicators and level, and the documents set aside (motivo). The language is the record's, else the catalogue's (handle, idioma), else detected."""
    aside = extracted.filter(F.col("texto").isNull()).select(*DOCUMENT, F.lit("sem texto extraído").alias("motivo"))
    docs = extracted.filter(F.col("texto").isNotNull())
    own = F.coalesce("idioma", F.lit(""))
    if catalogue is not None:
        docs = docs.join(catalogue.select("handle", F.col("idioma").alias("_c")), "handle", "left")
        own = F.when(own != "", own).otherwise(F.coalesce("_c", F.lit("")))
    docs = docs.withColumn("idioma", own)
    whole = docs.filter("idioma = ''").select(*DOCUMENT, F.lit(0).alias("pagina"), "idioma", "texto")
    found = quality.detect_language(whole, quality.page_words(whole), dictionary).select(*DOCUMENT, "idioma_detectado")
    docs = docs.join(found, DOCUMENT, "left").withColumn("detectado", (F.col("idioma") == "") & (F.coalesce("idioma_detectado", F.lit("")) != ""))
    docs = docs.withColumn("idioma", F.when(F.col("detectado"), F.col("idioma_detectado")).otherwise(F.col("idioma")))
    p = pages.split_pages(docs.select(*DOCUMENT, "idioma", "origem_por_pagina", "texto"))
    p = p.withColumn("origem", F.coalesce(F.try_element_at("origem_por_pagina", F.col("pagina")), F.lit(""))).drop("origem_por_pagina")
    keyed = p.withColumn("chave", F.struct(*quality.PAGE))
    texts = normalise.pages_text(keyed.select("chave", "idioma", "texto"), dictionary, "chave")
    n = p.drop("texto").join(texts.select("chave.*", "texto", "regras", "exemplos"), quality.PAGE)
    i = quality.indicators(n, dictionary).drop("idioma", "origem")
    none = F.lit(None).cast("double")
    rated = n.join(i, quality.PAGE).withColumn("nivel", quality.level(F.col("origem"), F.col("caracteres"), F.col("palavras"), F.col("fora_do_dicionario"), none))
    joined = pages.join_pages(n.select(*quality.PAGE, "texto"), DOCUMENT).join(docs.select(*DOCUMENT, "idioma", "detectado"), DOCUMENT)
    return joined, rated, aside


def warnings(documents: DataFrame) -> DataFrame:
    """(handle, aviso) of documents without a language, or with one that was only detected."""
    said: Column = F.when(F.col("idioma") == "", F.lit("sem idioma, sem medida do dicionário")).when(F.col("detectado"), F.concat(F.lit("sem idioma no catálogo; detectado "), "idioma"))
    return documents.select("handle", said.alias("aviso")).filter(F.col("aviso").isNotNull())
