"""Sessions, decisions around a provider, the cycle over questions, evaluation."""

import random

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import chunking, cycle, dialogue, evaluation, lexical, ranking, vectors
from corpuslens.streaming import incremental

EVENTS = "sessao_id string, ordem long, autor string, texto string, trechos int"
SAID = ["Quem foi?", "Escreva um texto", "algo", "", " pular ", "Responder", "1. O que pensa disso?\n2. ok", "curta?", "sem", None]


def random_events(n, seed):
    rng = random.Random(seed)
    return [(f"s{i}", j, rng.choice(["pessoa", "pessoa", "sistema"]), rng.choice(SAID), rng.choice([None, 0, 3])) for i in range(n) for j in range(rng.randint(1, 8))]


@pytest.mark.parametrize(("rounds", "on"), [(1, True), (2, True), (1, False)])
def test_sessions_equal_the_step_function(spark, rounds, on):
    rows = random_events(120, rounds)
    got = {r["sessao_id"]: tuple(r)[1:] for r in dialogue.sessions(spark.createDataFrame(rows, EVENTS), rounds, on).collect()}
    want = {}
    for s, _, author, text, n in rows:
        want[s] = incremental.step(want.get(s, ("triagem", 0, "")), author, text, n, rounds, on)
    assert got == want and {w[0] for w in want.values()} > {"recuperacao", "encerrada", "resposta"}


def test_session_by_hand(spark):
    rows = [("s", 1, "pessoa", "Quero entender isso", None), ("s", 2, "sistema", "O que você já sabe disso?", None), ("s", 3, "pessoa", " pouco ", None), ("s", 4, "sistema", "resposta", 4)]
    states = [dialogue.sessions(spark.createDataFrame(rows[:k], EVENTS)).first() for k in (1, 2, 3, 4)]
    assert [(r["estado"], r["rodadas"]) for r in states] == [("problematizacao", 0), ("problematizacao", 1), ("recuperacao", 1), ("resposta", 1)]
    assert states[-1]["consulta"] == "Quero entender isso\npouco"


def test_streams_of_sessions(spark, tmp_path):
    rows = random_events(20, 7)
    src = f"{tmp_path}/in"
    for k in range(2):
        spark.createDataFrame([r for r in rows if r[1] % 2 == k], EVENTS).write.mode("append").parquet(src)
    incremental.sessions_stream(spark.readStream.schema(EVENTS).parquet(src), f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    want = dialogue.sessions(spark.createDataFrame(rows, EVENTS)).collect()
    assert sorted(map(tuple, incremental.sessions_now(spark, f"{tmp_path}/out").collect())) == sorted(map(tuple, want))
    whole = f"{tmp_path}/whole"
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(whole)
    q = incremental.live_sessions(spark.readStream.schema(EVENTS).parquet(whole)).writeStream.format("memory").queryName("live").outputMode("update").option("checkpointLocation", f"{tmp_path}/d").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("live").collect())) == sorted(map(tuple, want))


def test_index_stream(spark, tmp_path):
    from corpuslens.sources.store import Collection

    store = Collection(spark, f"{tmp_path}/store", 64)
    chunks = [("a::0", "um dois"), ("a::1", "tres quatro"), ("a::0", "um dois")]
    spark.createDataFrame(chunks, "chunk_id string, texto string").write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        incremental.index_stream(spark.readStream.schema("chunk_id string, texto string").parquet(f"{tmp_path}/in"), store, f"{tmp_path}/c").awaitTermination()
    assert store.count() == 2
    q = vectors.hashed(spark.createDataFrame([(1, "quatro tres")], "consulta_id long, texto string"), "consulta_id")
    assert [(r["chunk_id"], round(r["score"], 6)) for r in store.search(q, 5, floor=0.9).collect()] == [("a::1", 1.0)]
    assert Collection(spark, f"{tmp_path}/none", 64).search(q, 5).count() == 0
    with pytest.raises(ValueError, match="1 vectors"):
        store.upsert(spark.createDataFrame([("x", [1.0])], "chunk_id string, vetor array<double>"))


def test_decisions(spark):
    rows = [("q1 comprida o bastante para isso", "1. alfa beta\n2. ALFA BETA\n3. gama", True, True, ""), ("curta", "1. alfa beta", True, True, ""), ("curta", "alpha beta\ngamma", True, True, "en"), ("curta", "alpha beta\ngamma", True, False, "en"), ("q", "x", False, True, ""), ("q", "x", True, False, ""), ("uma pergunta que é bem comprida", None, True, True, ""), ("uma pergunta que é bem comprida", "ok", True, True, "")]
    df = spark.createDataFrame(rows, "q string, o string, on boolean, split boolean, l string")
    got = [r[0] for r in df.select(dialogue.decompose(F.col("q"), F.col("o"), F.col("on"), F.col("split"), F.col("l"))).collect()]
    assert [g["subconsultas"] for g in got] == [[rows[0][0], "alfa beta", "gama"], ["curta"], ["curta", "alpha beta", "gamma"], ["curta", "alpha beta"], ["q"], ["q"], [rows[6][0]], [rows[7][0]]]
    assert [g["veio_do_modelo"] for g in got] == [True, False, True, True, False, False, False, False] and len({g["motivo"] for g in got}) == 6
    rows = [("e ele?", 0, "x"), ("e ele?", 2, None), ("e ele?", 2, " "), ("e ele?", 2, 'Pergunta: "quem foi ele"')]
    df = spark.createDataFrame(rows, "q string, n int, o string")
    got = [r[0] for r in df.select(dialogue.rewrite(F.col("q"), F.col("n"), F.col("o"))).collect()]
    assert [g["consulta"] for g in got] == ["e ele?"] * 3 + ["quem foi ele"] and [g["veio_do_modelo"] for g in got] == [False] * 3 + [True]


@pytest.fixture(scope="module")
def corpus(spark):
    docs = [(f"d{i}.txt", f"T{i}", f"texto sobre tema{i} com palavra{i % 3} e mais alguma coisa comum aqui para ter tamanho") for i in range(12)]
    p = chunking.chunks(spark.createDataFrame(docs, "documento_origem string, titulo_pagina string, corpo string")).persist()
    return p, lexical.build(p)


def test_answers(spark, corpus):
    p, index = corpus
    q = spark.createDataFrame([(1, "tema3 palavra1"), (2, "nadaqueexista")], "consulta_id long, texto string")
    hits = cycle.with_passages(lexical.search(index, q, 5), p)
    got = {r["consulta_id"]: r for r in cycle.answer(q, hits, lambda prompt: F.lit("ver Fonte 1 e Fonte 9")).collect()}
    assert got[2]["trechos"] == 0 and got[2]["prompt"] is None and got[2]["resposta"] is None
    assert got[1]["trechos"] == 5 and got[1]["citacoes_invalidas"] == ["Fonte 9"] and "[Fonte 1: T3]" in got[1]["prompt"]
    assert cycle.answer(q, hits, budget=60).filter("trechos = 1").count() == 1
    failed = cycle.answer(q, hits, lambda prompt: F.lit(None).cast("string")).filter("consulta_id = 1").first()
    assert failed["resposta"] is None and failed["citacoes_invalidas"] is None
    assert {(r["consulta_id"], r["fonte"]) for r in cycle.cited(cycle.answer(q, hits).filter("resposta is not null")).collect()} == {(1, 1)}


def test_service(spark, corpus):
    p, index = corpus
    base = lambda q, k: lexical.search(index, q, k)
    q = spark.createDataFrame([(1, "tema3"), (2, "uma pergunta comprida sobre tema4 e sobre tema5")], "consulta_id long, texto string")
    direct = cycle.Service(base, p, dynamic=False)
    assert direct.search(q, 3).count() <= 6
    split = lambda t: F.when(F.length(t) > 20, F.lit("1. tema4 palavra1\n2. tema5 palavra2"))
    s = cycle.Service(base, p, reranking=True, mediation=cycle.Mediation(on=True, output=split))
    assert {r["consulta_id"]: len(r["subconsultas"]) for r in s.decomposed(q).collect()} == {1: 1, 2: 3}
    got = [(r["consulta_id"], r["posicao"], r["chunk_id"]) for r in s.search(q).orderBy("consulta_id", "posicao").collect()]
    assert [g[2] for g in got if g[0] == 1] == ["d3.txt::0"]
    assert {g[2] for g in got if g[0] == 2} >= {"d4.txt::0", "d5.txt::0"} and [g[1] for g in got if g[0] == 2] == list(range(1, sum(g[0] == 2 for g in got) + 1))
    # A whole question goes through as it would without mediation.
    alone = cycle.Service(base, p, reranking=True, mediation=cycle.Mediation(on=True)).search(q).collect()
    assert sorted(map(str, alone)) == sorted(map(str, cycle.Service(base, p).search(q).collect()))


def test_evaluation(spark, corpus):
    p, index = corpus
    q = spark.createDataFrame([(1, "tema3 palavra1"), (2, "e ele?")], "consulta_id long, texto string")
    gold = spark.createDataFrame([(1, "f", "T3"), (1, "f", "T9"), (2, "e", "T7")], "consulta_id long, tipo string, pagina string")
    search = lambda asked: cycle.with_passages(lexical.search(index, asked, 5), p)
    raw = evaluation.run(q, gold, search, fit=lambda asked, hits: cycle.fitting(asked, hits, 60))
    row = {r["consulta_id"]: r for r in raw.collect()}
    assert (row[1]["acertos"], row[1]["primeira"], row[1]["trechos_no_prompt"], row[1]["cortado"], row[1]["acertou_no_prompt"]) == (1, 1, 1, True, True)
    assert (row[2]["trechos"], row[2]["cortado"], row[2]["acertou_no_prompt"]) == (0, False, False)
    better = evaluation.run(q, gold, search, rewrite=lambda a: a.withColumn("texto", F.when(F.col("consulta_id") == 2, "tema7").otherwise(F.col("texto"))))
    s = {r["rotulo"]: r for r in evaluation.side_by_side(raw.drop("cortado", "trechos_no_prompt", "acertou_no_prompt"), better, ("cru", "reescrito")).collect()}
    assert s["cru"]["recall"] == 0.5 and s["reescrito"]["recall"] == 1.0 and (s["cru"]["diferenca"], s["reescrito"]["diferenca"]) == (0.0, 0.5)
    whole = evaluation.summary(raw).first()
    assert (whole["casos_cortados"], whole["recall_no_prompt"]) == (1, 0.5)
    empty = evaluation.summary(raw.limit(0)).first()
    assert (empty["casos"], empty["recall"], empty["recall_no_prompt"]) == (0, 0.0, 0.0)
    assert [evaluation.effective_k(k, d, r) for k, d, r in ((5, True, True), (None, True, False), (None, True, True), (None, False, False))] == [5, None, 8, 8]


def test_pool_and_dense_ties(spark):
    assert (ranking.pool_size(True), ranking.pool_size(True, k=80), ranking.pool_size(False, True), ranking.pool_size(False, False)) == (50, 80, 20, 8)
    c = spark.createDataFrame([(f"c{i}", [1.0, float(i // 5)]) for i in range(10)] + [("z", [0.0, 0.0])], "chunk_id string, vetor array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "consulta_id long, vetor array<double>")
    assert [r["chunk_id"] for r in vectors.search(q, c, 7, block=3).orderBy("posicao").collect()] == [f"c{i}" for i in range(7)]
    assert vectors.search(q.limit(0), c, 3).count() == 0
