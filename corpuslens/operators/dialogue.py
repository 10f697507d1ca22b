"""Conversation memory, triage and reading of model output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fn

# Opening cues, escape words, echoes of the prompt.
PRODUCT_CUES = ("faça", "faca ", "monte", "escreva", "elabore", "redija", "crie", "formule", "gere um", "gere uma", "modelo de", "me dê pronto", "minuta")
FACT_CUES = ("o que é", "o que foi", "o que são", "quem é", "quem foi", "quem são", "quando", "quantos", "quantas", "onde fica", "qual o significado", "qual é a definição")
ESCAPES = ("pular", "seguir", "responder", "/pular", "/seguir", "/responder")
ECHOES = ("sub-consulta", "subconsulta", "consultas:", "pergunta original", "aqui estão", "claro,")
KINDS = ("produto_acabado", "duvida_factual", "exploracao")
MARKER = r"^\s*(?:\d+[.)\]]|[-*•–—])\s*"
REMEMBERED, IN_PROMPT, ANSWER_SIZE, REWRITE_ANSWER_SIZE = 3, 2, 600, 400


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def kind_by_cues(question: Column | str) -> Column:
    t = F.lower(fn.strip(question))
    product = _any([t.startswith(c) | t.contains(f" {c}") for c in PRODUCT_CUES])
    return F.when(product, F.lit("produto_acabado")).when(_any([t.startswith(c) for c in FACT_CUES]), F.lit("duvida_factual")).otherwise(F.lit("indefinido"))


def kind_from_model(answer: Column | str) -> Column:
    t, out = F.lower(fn.strip(answer)), F.lit("indefinido")
    for k in reversed(KINDS):
        out = F.when(t.contains(k) | t.contains(k.replace("_", " ")), F.lit(k)).otherwise(out)
    return out


def final_kind(question: Column | str, answer: Column | str) -> Column:
    """A finished product by the cues beats the model; an undefined model answer falls back on the cues."""
    cues, model = kind_by_cues(question), kind_from_model(answer)
    return F.when((cues == "produto_acabado") | (model == "indefinido"), cues).otherwise(model)


def next_state(kind: Column, problematise: Column) -> Column:
    return F.when(problematise & (kind != "duvida_factual"), F.lit("problematizacao")).otherwise(F.lit("recuperacao"))


def lines_of(output: Column | str, least: int = 0, most: int = 10**9, limit: int = 4, not_like: Column | None = None, echoes: tuple[str, ...] = (), must: str | None = None) -> Column:
    """Lines without list marks and quotes, of the right length, first of equal ones (whatever their case), at most `limit`."""
    lines = F.transform(F.split(fn.col(output), "\r\n|\r|\n"), lambda x: fn.strip(F.regexp_replace(fn.strip(F.regexp_replace(x, MARKER, "")), '^"+|"+$', "")))
    fit = F.filter(lines, lambda x: (F.length(x) >= least) & (F.length(x) <= most) & ~_any([F.lower(x).contains(e) for e in echoes]) & (x.contains(must) if must else F.lit(True)))
    if not_like is not None:
        fit = F.filter(fit, lambda x: F.lower(x) != F.lower(fn.strip(not_like)))
    def distinct(f: Column) -> Column:
        low = F.transform(f, F.lower)
        return fn.let(low, lambda seen: F.filter(f, lambda x, i: F.array_position(seen, F.lower(x)) == i + 1))

    return F.slice(fn.let(fit, distinct), 1, limit)


def sub_questions(output: Column | str, question: Column, most: int = 4) -> Column:
    return lines_of(output, least=4, most=200, limit=most, not_like=question, echoes=ECHOES)


def returned_questions(output: Column | str, most: int = 3) -> Column:
    return lines_of(output, least=10, most=300, limit=most, must="?")


def rewritten(output: Column | str, question: Column | str) -> Column:
    """The first useful line, free of arrow, label and quotes; '' if there is none or it has grown too much."""

    def clean(x: Column) -> Column:
        x = fn.strip(F.regexp_replace(fn.strip(x), r"^[\-\>•*]+", ""))
        for label in ("nova:", "pergunta:", "reescrita:"):
            x = F.when(F.lower(x).startswith(label), fn.strip(F.substring(x, len(label) + 1, 1 << 30))).otherwise(x)
        return fn.strip(F.regexp_replace(x, "^[\"'“”]+|[\"'“”]+$", ""))

    useful = F.filter(F.transform(F.split(fn.col(output), "\r\n|\r|\n"), clean), lambda x: x != "")
    first, n = F.coalesce(F.try_element_at(useful, F.lit(1)), F.lit("")), F.length(fn.col(question))
    return F.when(F.length(first) <= F.greatest(n * 4, n + 160), first).otherwise(F.lit(""))


def exchanges(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> one row a user turn with the assistant's next turn, numbered."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    t = turns.withColumn("_r", F.lead("role").over(by)).withColumn("_t", F.lead("text").over(by)).filter("role = 'user'")
    t = t.withColumn("resposta", F.when(F.col("_r") == "assistant", F.col("_t")).otherwise(F.lit("")))
    return t.select("conv_id", "turn", F.row_number().over(by).alias("troca"), F.col("text").alias("pergunta"), F.coalesce("resposta", F.lit("")).alias("resposta"))


def memory(asked: DataFrame, n: int = IN_PROMPT, size: int = ANSWER_SIZE) -> DataFrame:
    """Each question with the formatted `n` exchanges before it."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-n, -1)
    answer = F.when(F.col("resposta") == "", F.lit("")).otherwise(F.concat(F.lit("\nResposta: "), fn.truncate("resposta", size)))
    block = F.concat(F.lit("Pergunta: "), F.col("pergunta"), answer)
    return asked.withColumn("historico", F.array_join(F.collect_list(block).over(before), "\n\n"))


def consolidated(turns: DataFrame, states: str = "estado") -> DataFrame:
    """(sessao_id, ordem, autor, texto, estado, pergunta_inicial) -> the question and the person's answers while problematising."""
    said = F.when((F.col("autor") == "pessoa") & (F.col(states) == "problematizacao"), F.struct("ordem", "texto"))
    g = turns.groupBy("sessao_id").agg(F.first("pergunta_inicial").alias("q"), F.array_sort(F.collect_list(said)).alias("a"))
    return g.select("sessao_id", F.array_join(F.concat(F.array("q"), F.filter(F.transform("a", lambda x: fn.strip(x["texto"])), lambda x: x != "")), "\n").alias("consulta"))


# ── decisions around a provider's answer (null: the provider failed) ──


def rewrite(question: Column, remembered: Column, output: Column) -> Column:
    """What goes to the search: the question as it is without history, when the provider failed or gave nothing usable; else the rewritten one."""
    new = rewritten(output, question)
    reason = (
        F.when(remembered <= 0, F.lit("primeira pergunta da conversa"))
        .when(output.isNull(), F.lit("o modelo não respondeu"))
        .when(new == "", F.lit("o modelo não devolveu reescrita aproveitável"))
        .otherwise(F.lit(""))
    )
    return fn.let(F.struct(reason.alias("r"), new.alias("n")), lambda s: F.struct(F.when(s["r"] == "", s["n"]).otherwise(question).alias("consulta"), (s["r"] == "").alias("veio_do_modelo"), s["r"].alias("motivo")))


def decompose(question: Column, output: Column, on: Column, splitting: Column, language: Column, least: int = 25, most: int = 4, with_original: bool = True) -> Column:
    """The sub-questions to search, and why there is only the question itself if so. Short questions aren't worth splitting, but are worth translating."""
    subs = F.when(splitting, sub_questions(output, question, most)).otherwise(sub_questions(output, question, 1))
    reason = (
        F.when(~on, F.lit("mediação desligada"))
        .when(~splitting & (language == ""), F.lit("nada a preparar: sem decomposição nem tradução"))
        .when(splitting & (language == "") & (F.length(fn.strip(question)) < least), F.lit("pergunta curta demais para valer uma reformulação"))
        .when(output.isNull(), F.lit("o modelo não respondeu"))
        .when(F.size(subs) == 0, F.lit("o modelo não devolveu consulta legível"))
        .otherwise(F.lit(""))
    )

    def tree(s: Column) -> Column:
        whole = F.concat(F.array(question), s["s"]) if with_original else s["s"]
        return F.struct(F.when(s["r"] == "", whole).otherwise(F.array(question)).alias("subconsultas"), (s["r"] == "").alias("veio_do_modelo"), s["r"].alias("motivo"))

    return fn.let(F.struct(reason.alias("r"), F.coalesce(subs, F.array().cast("array<string>")).alias("s")), tree)


# ── a session's states, as a fold over its events ──

EVENT = "struct<ordem:bigint,autor:string,texto:string,trechos:int>"
STATE = "struct<estado:string,rodadas:int,consulta:string>"


def after(state: Column, event: Column, rounds: int, problematise: bool) -> Column:
    """The state after one event. A person's message opens the session or answers; the system's returns questions (a round), or
    once there is something to search, the answer (RESPOSTA with passages, ENCERRADA without); after an answer it closes."""
    said = fn.strip(F.coalesce(event["texto"], F.lit("")))
    now = lambda name, done=None, query=None: F.struct(F.lit(name).alias("estado"), (state["rodadas"] if done is None else done).alias("rodadas"), (state["consulta"] if query is None else query).alias("consulta"))
    at = lambda name: state["estado"] == name
    person = event["autor"] == "pessoa"
    asked = F.coalesce(event["texto"], F.lit(""))
    direct = F.lit(not problematise) | (kind_by_cues(asked) == "duvida_factual")
    skip = (said == "") | F.lower(said).isin(*ESCAPES)
    more = F.concat(state["consulta"], F.lit("\n"), said)
    return (
        F.when(at("triagem") & person, F.when(direct, now("recuperacao", query=asked)).otherwise(now("problematizacao", query=asked)))
        .when(at("problematizacao") & person, F.when(skip, now("recuperacao")).when(state["rodadas"] >= rounds, now("recuperacao", query=more)).otherwise(now("problematizacao", query=more)))
        .when(at("problematizacao"), F.when(F.size(returned_questions(F.coalesce(event["texto"], F.lit("")))) == 0, now("recuperacao")).otherwise(now("problematizacao", done=state["rodadas"] + 1)))
        .when(at("recuperacao") & ~person, F.when(F.coalesce(event["trechos"], F.lit(0)) > 0, now("resposta")).otherwise(now("encerrada")))
        .when(at("resposta") & ~person, now("encerrada"))
        .otherwise(state)
    )


def sessions(events: DataFrame, rounds: int = 1, problematise: bool = True) -> DataFrame:
    """(sessao_id, ordem, autor, texto, trechos) -> each session's state after its events (sessao_id, estado, rodadas, consulta)."""
    event = F.struct(F.col("ordem").cast("long").alias("ordem"), "autor", "texto", F.col("trechos").cast("int").alias("trechos")).cast(EVENT)
    start = F.struct(F.lit("triagem").alias("estado"), F.lit(0).alias("rodadas"), F.lit("").alias("consulta")).cast(STATE)
    folded = F.aggregate(F.array_sort(F.collect_list(event)), start, lambda s, e: after(s, e, rounds, problematise).cast(STATE))
    return events.groupBy("sessao_id").agg(folded.alias("s")).select("sessao_id", "s.*")
