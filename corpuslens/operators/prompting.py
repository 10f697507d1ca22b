"""Prompt assembly: budgets, order of passages, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fn

WINDOW, RESERVE = 8192, 1024
INSTRUCTION = "Responda em português, só com o que está nos trechos, e cite a fonte de cada afirmação."


def cost(title: Column | str, text: Column | str) -> Column:
    return fn.token_estimate(F.concat(F.lit("[Fonte 00: "), fn.col(title), F.lit("]\n"), fn.col(text), F.lit("\n\n")))


def fit_budget(ranking: DataFrame, budget: int = WINDOW - RESERVE, overhead: int | Column = 0) -> DataFrame:
    """Whole passages in order until one overflows; the first always enters; a budget of 0 is off. `overhead` may be a column of the ranking."""
    if budget <= 0:
        return ranking
    run = Window.partitionBy("consulta_id").orderBy("posicao").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = ranking.withColumn("custo", cost("titulo_pagina", "texto")).withColumn("acumulado", F.sum("custo").over(run))
    first = F.min("posicao").over(Window.partitionBy("consulta_id"))
    return r.withColumn("_first", first).filter((F.col("posicao") == F.col("_first")) | (F.col("acumulado") <= F.lit(budget) - overhead)).drop("_first")


def passages_block(ranking: DataFrame) -> DataFrame:
    """(consulta_id, trechos, n): labelled passages, best at both ends; the label is the rank, not the place."""
    nth = F.row_number().over(Window.partitionBy("consulta_id").orderBy("posicao"))
    block = F.concat(F.lit("[Fonte "), F.col("_n").cast("string"), F.lit(": "), F.col("titulo_pagina"), F.lit("]\n"), F.col("texto"))
    side = F.when(F.col("_n") % 2 == 1, F.struct(F.lit(0).alias("s"), F.col("_n").alias("p"))).otherwise(F.struct(F.lit(1).alias("s"), (-F.col("_n")).alias("p")))
    listed = ranking.withColumn("_n", nth).groupBy("consulta_id").agg(F.array_sort(F.collect_list(F.struct(side.alias("k"), block.alias("b")))).alias("l"), F.count("*").alias("n"))
    return listed.select("consulta_id", F.array_join(F.transform("l", lambda x: x["b"]), "\n\n").alias("trechos"), "n")


def prompt(question: Column | str, passages: Column | str, sections: list[tuple[str, str]] | None = None, history: Column | None = None) -> Column:
    """Guidance, earlier conversation if any, passages, question."""
    head = "\n\n".join(f"{title.upper()}\n{text}" for title, text in sections) if sections else INSTRUCTION
    past = F.lit("") if history is None else F.when(F.trim(F.coalesce(history, F.lit(""))) == "", F.lit("")).otherwise(F.concat(F.lit("CONVERSA ANTERIOR:\n"), history, F.lit("\n\n")))
    return F.concat(F.lit(head + "\n\n"), past, F.lit("TRECHOS RECUPERADOS:\n"), fn.col(passages), F.lit("\n\nPERGUNTA:\n"), fn.col(question))


def overhead(question: Column | str, sections: list[tuple[str, str]] | None = None, history: Column | None = None) -> Column:
    """The estimated tokens of a prompt without passages: what guidance, conversation and question take from the budget."""
    return fn.token_estimate(prompt(question, F.lit(""), sections, history))


def prompts(questions: DataFrame, ranking: DataFrame, sections: list[tuple[str, str]] | None = None, history: Column | None = None) -> DataFrame:
    """One prompt a question with passages."""
    q = questions.join(passages_block(ranking), "consulta_id")
    return q.select("consulta_id", prompt("texto", "trechos", sections, history).alias("prompt"), "n")


def invalid_citations(answer: Column | str, n: Column | int) -> Column:
    """`Fonte N` with N outside 1..n, repeats kept."""
    found = F.transform(F.regexp_extract_all(fn.col(answer), F.lit(r"(?i)\bFonte\s+(\d+)"), 1), lambda d: d.cast("long"))
    n = F.lit(n) if isinstance(n, int) else n
    return F.transform(F.filter(found, lambda i: (i < 1) | (i > n)), lambda i: F.concat(F.lit("Fonte "), i.cast("string")))
