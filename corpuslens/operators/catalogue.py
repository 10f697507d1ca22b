"""Catalogue derivation with closed mappings and fail-closed access (an extension of the archive's design)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANGUAGE_ORDER = ("pt_BR", "pt", "none", "", "es", "en", "fr")
SEVERITY = ("publicavel", "interno", "vedado")


def first_by_language(fields: DataFrame) -> DataFrame:
    """(handle, campo, idioma, valor) -> the value of the preferred language, its source, and whether others differ."""
    rank = F.array_position(F.array(*map(F.lit, LANGUAGE_ORDER)), F.coalesce("idioma", F.lit("none")))
    f = fields.filter(F.trim("valor") != "").withColumn("r", F.when(rank == 0, 99).otherwise(rank))
    return f.groupBy("handle", "campo").agg(F.min(F.struct("r", "valor", "idioma")).alias("m"), (F.count_distinct("valor") > 1).alias("conflito")).select("handle", "campo", F.col("m.valor").alias("valor"), F.col("m.idioma").alias("origem"), "conflito")


def all_values(fields: DataFrame) -> DataFrame:
    """Values split on `||`, distinct, sorted."""
    v = fields.select("handle", "campo", F.explode(F.split("valor", r"\|\|")).alias("v")).select("handle", "campo", F.trim("v").alias("v"))
    return v.filter("v <> ''").groupBy("handle", "campo").agg(F.array_sort(F.collect_set("v")).alias("valores"))


def handle_id(url: Column) -> Column:
    """The last two path parts as hdl-prefix-suffix; null without them."""
    p, s = F.regexp_extract(url, r"(\d+(?:\.\d+)*)/(\w+)/?$", 1), F.regexp_extract(url, r"(\d+(?:\.\d+)*)/(\w+)/?$", 2)
    return F.when((p != "") & (s != ""), F.concat_ws("-", F.lit("hdl"), p, s))


def mapped_type(value: Column, mapping: dict[str, str], default: Column) -> Column:
    """Empty: the collection's default; unmapped: null (out)."""
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.when(F.trim(F.coalesce(value, F.lit(""))) == "", default).otherwise(F.try_element_at(pairs, value))


def most_restrictive(*levels: Column) -> Column:
    """Of several restrictions the severest; an unknown or missing one is the severest."""
    rank = lambda c: F.when(F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITY)), c), F.lit(0)) == 0, 3).otherwise(F.array_position(F.array(*map(F.lit, SEVERITY)), c))
    worst = F.greatest(*[rank(c) for c in levels]) if len(levels) > 1 else rank(levels[0])
    return F.element_at(F.array(*map(F.lit, SEVERITY)), worst.cast("int"))


def allowed(passages: DataFrame, restrictions: tuple[str, ...] = ("publicavel",)) -> DataFrame:
    """Inclusion list, applied before anything is ranked; null is out."""
    return passages.filter(F.col("restricao_uso").isin(*restrictions))


def year(issued: Column, accession: Column) -> Column:
    """(ano, precisao): from the issue date, else from the accession, as an approximation."""
    y, z = F.regexp_extract(F.coalesce(issued, F.lit("")), r"\d{4}", 0), F.regexp_extract(F.coalesce(accession, F.lit("")), r"\d{4}", 0)
    return F.struct(F.coalesce(F.nullif(y, F.lit("")), F.nullif(z, F.lit(""))).cast("int").alias("ano"), F.when(y != "", "exata").when(z != "", "aproximada").otherwise("ausente").alias("precisao"))


def blocking_problems(records: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """(handle, motivo) for every required column that is null or empty, and for repeated handles."""
    reasons = F.filter(F.array(*[F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", F.lit(f"campo ausente: {c}")) for c in required]), lambda x: x.isNotNull())
    twice = records.groupBy("handle").count().filter("count > 1").select("handle", F.lit("handle repetido").alias("motivo"))
    return records.select("handle", F.explode(reasons).alias("motivo")).unionByName(twice)
