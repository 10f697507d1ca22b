"""The online cycle over a whole table of questions: search, budget, prompt, answer, citations; and how its parts are put together."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fn
from . import dialogue, prompting, ranking

Search = Callable[[DataFrame, int | None], DataFrame]  # (consulta_id, texto), k -> consulta_id, posicao, chunk_id, score
Generate = Callable[[Column], Column]  # prompt -> answer, null where the provider failed


def echo(prompt: Column) -> Column:
    """The generator that needs no model: it points at the first source."""
    return F.concat(F.lit("Conforme a Fonte 1, "), F.length(prompt).cast("string"), F.lit(" caracteres de contexto."))


def fitting(questions: DataFrame, hits: DataFrame, budget: int = prompting.WINDOW - prompting.RESERVE, sections: list[tuple[str, str]] | None = None, history: Column | None = None) -> DataFrame:
    """The hits (with titulo_pagina, texto) that fit beside guidance, conversation and question."""
    over = questions.select("consulta_id", prompting.overhead("texto", sections, history).alias("_over"))
    return prompting.fit_budget(hits.join(over, "consulta_id"), budget, F.col("_over")).drop("_over")


def answer(questions: DataFrame, hits: DataFrame, generate: Generate = echo, budget: int = prompting.WINDOW - prompting.RESERVE, sections: list[tuple[str, str]] | None = None, history: Column | None = None) -> DataFrame:
    """(consulta_id, prompt, trechos, resposta, citacoes_invalidas) of every question. Without passages nothing is generated: all but
    the id is null, and `trechos` 0. `hits` are a search's, with titulo_pagina and texto."""
    prompts = prompting.prompts(questions, fitting(questions, hits, budget, sections, history), sections, history)
    said = prompts.withColumn("resposta", generate(F.col("prompt")))
    checked = said.select("consulta_id", "prompt", F.col("n").alias("trechos"), "resposta", F.when(F.col("resposta").isNotNull(), prompting.invalid_citations("resposta", F.col("n"))).alias("citacoes_invalidas"))
    out = questions.select("consulta_id").join(checked, "consulta_id", "left")
    return out.withColumn("trechos", F.coalesce("trechos", F.lit(0)))


@dataclass
class Mediation:
    """What is prepared before a search. `output` gives a provider's lines for a question (null: it failed)."""

    on: bool = False
    split: bool = True
    language: str = ""
    least: int = 25
    most: int = 4
    per_sub_question: int = 8
    per_document: int = 0
    output: Callable[[Column], Column] | None = None


@dataclass
class Service:
    """How searching is put together: a base search (dense or hybrid), mediation around it, one reranking.

    With mediation on, the base search never reranks; mediation does once, on the fused list. A question that stays whole then goes
    to the base search as it is, so it isn't reranked and its number of passages is the policy's."""

    base: Search
    passages: DataFrame
    reranking: bool = False
    dynamic: bool = True
    mediation: Mediation | None = None

    def direct(self, questions: DataFrame, k: int | None = None, rerank: bool | None = None) -> DataFrame:
        rerank = self.reranking and not (self.mediation and self.mediation.on) if rerank is None else rerank
        pool = self.base(questions, ranking.pool_size(rerank, False, k or (ranking.K_MOST if self.dynamic else None)))
        if rerank:
            texts = pool.join(self.passages.select("chunk_id", "texto"), "chunk_id").join(questions.select("consulta_id", F.col("texto").alias("_q")), "consulta_id")
            pool = ranking.rerank(texts, ranking.overlap("_q", "texto")).select(*pool.columns)
        return ranking.decide_quantity(pool, k, rerank, ranking.RELATIVE if self.dynamic else 0.0)

    def decomposed(self, questions: DataFrame) -> DataFrame:
        """(consulta_id, texto, subconsultas, veio_do_modelo, motivo)."""
        m = self.mediation or Mediation()
        said = m.output(F.col("texto")) if m.output else F.lit(None).cast("string")
        d = dialogue.decompose(F.col("texto"), said, F.lit(m.on), F.lit(m.split), F.lit(m.language), m.least, m.most)
        return questions.withColumn("_d", d).select(*questions.columns, "_d.*")

    def search(self, questions: DataFrame, k: int | None = None) -> DataFrame:
        if not (self.mediation and self.mediation.on):
            return self.direct(questions, k)
        q = self.decomposed(questions)
        whole = q.filter(F.size("subconsultas") == 1).select("consulta_id", F.col("subconsultas")[0].alias("texto"))
        subs = q.filter(F.size("subconsultas") > 1).select(F.col("consulta_id").alias("_q"), F.posexplode("subconsultas").alias("_s", "texto"))
        subs = subs.withColumn("consulta_id", F.struct("_q", "_s"))
        pool = max(self.mediation.per_sub_question, k or 0, ranking.K_MOST if self.dynamic and k is None else 0)
        found = self.base(subs.select(F.to_json("consulta_id").alias("consulta_id"), "texto"), pool)
        kind = questions.schema["consulta_id"].dataType.simpleString()
        found = found.withColumn("consulta_id", F.get_json_object("consulta_id", "$._q").cast(kind))
        mediated = ranking.mediate(found, self.passages, questions, self.mediation.per_document, self.reranking, k)
        alone = self.direct(whole, k)
        return alone.unionByName(mediated.select(*alone.columns))


def with_passages(hits: DataFrame, passages: DataFrame) -> DataFrame:
    return hits.join(passages.select("chunk_id", "titulo_pagina", "texto"), "chunk_id")


def renumbered(hits: DataFrame) -> DataFrame:
    """Positions from 1 without gaps."""
    return hits.withColumn("posicao", F.row_number().over(Window.partitionBy("consulta_id").orderBy("posicao")))


def cited(answers: DataFrame) -> DataFrame:
    """(consulta_id, fonte): every source number that an answer names."""
    found = F.regexp_extract_all(fn.col("resposta"), F.lit(r"(?i)\bFonte\s+(\d+)"), 1)
    return answers.select("consulta_id", F.explode(F.array_distinct(found)).alias("fonte")).select("consulta_id", F.col("fonte").cast("int").alias("fonte"))
