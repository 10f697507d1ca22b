"""Archive exports: items, languages, image coverage, recognition sidecars and confidences, checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as fn


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: documento_origem, titulo_pagina (heading), corpo."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("documento_origem"), "value")
    return t.select("documento_origem", fn.title_of("value").alias("titulo_pagina"), fn.body_of("value").alias("corpo"))


def originals(items: DataFrame) -> DataFrame:
    """(pasta, handle, contents): files of the ORIGINAL bundle (the default), without a path, that end in .pdf."""
    line = items.select("pasta", F.coalesce(F.nullif(F.trim("handle"), F.lit("")), F.col("pasta")).alias("handle"), F.explode(F.split("contents", "\n")).alias("l"))
    part = line.withColumn("arquivo", F.trim(F.element_at(F.split("l", "\t"), 1))).withColumn("bundle", F.coalesce(F.nullif(F.regexp_extract("l", r"bundle:(\w+)", 1), F.lit("")), F.lit("ORIGINAL")))
    return part.filter((F.col("bundle") == "ORIGINAL") & F.lower("arquivo").endswith(".pdf") & ~F.col("arquivo").rlike(r"[/\\]")).select("handle", "pasta", "arquivo")


def item_warnings(items: DataFrame) -> DataFrame:
    """(pasta, aviso) of items whose `contents` is missing or lists no original PDF."""
    listed = originals(items.filter(F.col("contents").isNotNull())).select("pasta").distinct().withColumn("_has", F.lit(True))
    j = items.join(listed, "pasta", "left")
    said = F.when(F.col("contents").isNull(), F.lit("item sem contents")).when(F.col("_has").isNull(), F.lit("nenhum PDF original"))
    return j.select("pasta", said.alias("aviso")).filter(F.col("aviso").isNotNull())


def missing(listed: DataFrame, present: DataFrame) -> DataFrame:
    return listed.join(present, ["pasta", "arquivo"], "left_anti")


def dublin_core(xml: Column | str) -> Column:
    """Title (no qualifier) and tool language of an item's metadata."""
    x = fn.col(xml)
    title = F.xpath_string(x, F.lit("//dcvalue[@element='title' and (not(@qualifier) or @qualifier='' or @qualifier='none')]"))
    langs = F.transform(F.xpath(x, F.lit("//dcvalue[@element='language']/text()")), fn.tool_language)
    return F.struct(fn.strip(title).alias("titulo"), F.coalesce(F.try_element_at(F.filter(langs, lambda s: s != ""), F.lit(1)), F.lit("")).alias("idioma"))


def coverage(images: DataFrame, pages: DataFrame) -> DataFrame:
    """The largest share of each page that one image covers; 0 without images."""
    j = pages.join(images, ["arquivo", "pagina"], "left")
    area = (F.col("w") / F.col("xppi") * 72) * (F.col("h") / F.col("yppi") * 72) / F.nullif(F.col("largura") * F.col("altura"), F.lit(0.0))
    return j.groupBy("arquivo", "pagina").agg(F.coalesce(F.max(F.when((F.col("xppi") > 0) & (F.col("yppi") > 0), area)), F.lit(0.0)).alias("cobertura"))


def needs_recognition(pages: DataFrame, least: int = 50, covered: float = 0.9) -> DataFrame:
    has = fn.has_text("texto", least)
    return pages.withColumn("reconhecer", ~has | (F.col("cobertura") >= covered))


def origin(ours: Column, text: Column | str, earlier: Column, least: int = 50) -> Column:
    return F.when(ours, "ocr").when(~fn.has_text(text, least), "sem_texto").when(earlier, "ocr_anterior").otherwise("digital_nativo")


def choose_reading(earlier: Column, ours: Column, earlier_share: Column, our_share: Column) -> Column:
    """Ours unless it is empty or misses the dictionary more often; without measures ours."""
    keep = (fn.strip(ours) == "") | F.coalesce(our_share > earlier_share, F.lit(False))
    return F.when(keep, earlier).otherwise(ours)


def sidecar_pages(sidecars: DataFrame) -> DataFrame:
    """(arquivo, texto) -> (arquivo, pagina, texto, certo): pieces between form feeds; a notice stands for the pages it names."""
    notice = r"(?s)^\s*\[OCR skipped on page(?:\(s\))?s? (\d+)(?:\s*-\s*(\d+))?\]\s*$"
    p = sidecars.select("arquivo", F.posexplode(F.split("texto", "\f")).alias("i", "texto"))
    a, b = F.nullif(F.regexp_extract("texto", notice, 1), F.lit("")).cast("int"), F.nullif(F.regexp_extract("texto", notice, 2), F.lit("")).cast("int")
    p = p.withColumn("de", a).withColumn("ate", F.coalesce(b, a)).withColumn("n", F.when(F.col("de").isNull(), 1).otherwise(F.col("ate") - F.col("de") + 1))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("arquivo").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    p = p.withColumn("pagina", (before + 1).cast("int"))
    return p.withColumn("certo", F.col("de").isNull() | ((F.col("de") == F.col("pagina")) & (F.col("ate") >= F.col("de"))))


def word_confidence(tsv: DataFrame) -> DataFrame:
    """(pagina, tsv) -> mean confidence of level-5 words with text, null if none."""
    f = F.split(F.col("l"), "\t", -1)
    rows = tsv.select("pagina", F.explode(F.slice(F.split("tsv", "\n"), 2, 1 << 30)).alias("l")).withColumn("f", f)
    ok = (F.size("f") == 12) & (F.col("f")[0] == "5") & (F.trim(F.col("f")[11]) != "")
    value = F.when(ok, F.col("f")[10].try_cast("double"))
    means = rows.groupBy("pagina").agg(F.avg(F.when(value >= 0, value)).alias("confianca"))
    return tsv.select("pagina").join(means, "pagina", "left")


def changed_files(files: DataFrame, done: DataFrame) -> DataFrame:
    """binaryFile rows whose checksum isn't recorded yet."""
    return files.withColumn("sha256", F.sha2("content", 256)).join(done.select("path", "sha256"), ["path", "sha256"], "left_anti")
