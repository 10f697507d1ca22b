"""Passages and gold sets as JSON lines; corrupt lines are errors that name the line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK = "chunk_id string, texto string, documento_origem string, titulo_pagina string, chunk_index int, pagina int, secao string, inicio int, fim int, versao_embedding string, restricao_uso string"
CASE = "id string, demanda string, paginas_esperadas array<string>, tipo_de_demanda string, observacao string, historico array<string>"
OPTIONAL = {"pagina": 0, "secao": "", "inicio": 0, "fim": 0, "versao_embedding": "", "restricao_uso": ""}


class InputError(ValueError):
    pass


def _parsed(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """All lines with a number that grows in their order, and those that aren't blank, read (a broken one has `r._bad`)."""
    lines = spark.read.text(path).withColumn("_line", F.monotonically_increasing_id())
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    return lines, lines.filter(F.trim("value") != "").withColumn("r", F.from_json("value", schema + ", _bad string", options))


def _refuse(lines: DataFrame, wrong: DataFrame) -> None:
    """An error that names the first lines of (_line, motivo), if there are any. A line's number is the count of lines up to it."""
    first = wrong.orderBy("_line", "motivo").limit(5).collect()
    if first:
        at = lines.agg(*[F.count_if(F.col("_line") <= r["_line"]) for r in first]).first()
        raise InputError("; ".join(f"line {n}: {r['motivo']}" for n, r in zip(at, first, strict=True)))


def _broken(parsed: DataFrame, required: tuple[str, ...]) -> DataFrame:
    missing = F.lit(False)
    for c in required:
        missing = missing | F.col(f"r.{c}").isNull()
    why = F.when(F.col("r").isNull() | F.col("r._bad").isNotNull(), F.lit("JSON inválido")).when(missing, F.lit("campo ausente"))
    return parsed.select("_line", why.alias("motivo")).filter(F.col("motivo").isNotNull())


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Missing optional fields get their neutral values; a corrupt line, or one without id or text, fails the scan."""
    lines, parsed = _parsed(spark, path, CHUNK)
    _refuse(lines, _broken(parsed, ("chunk_id", "texto")))
    return parsed.select("r.*").drop("_bad").fillna(OPTIONAL)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Optional fields with neutral values are left out of the record. The commit is all or nothing."""
    blank = [F.nullif(F.col(c), F.lit(OPTIONAL[c])).alias(c) if c in OPTIONAL else F.col(c) for c in chunks.columns]
    chunks.select(*blank).write.mode("overwrite").option("ignoreNullFields", True).json(path)


def problems(cases: DataFrame) -> DataFrame:
    """(_line, motivo) of a gold set as read line by line."""
    nth = F.row_number().over(Window.partitionBy("r.id").orderBy("_line"))
    again = cases.filter(F.col("r.id").isNotNull()).withColumn("_n", nth).filter("_n > 1").select("_line", F.lit("id repetido").alias("motivo"))
    return _broken(cases, ("id", "demanda", "paginas_esperadas")).unionByName(again)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    lines, parsed = _parsed(spark, path, CASE)
    _refuse(lines, problems(parsed))
    out = parsed.select("r.*").drop("_bad")
    if out.isEmpty():
        raise InputError(f"{path} has no case")
    return out
