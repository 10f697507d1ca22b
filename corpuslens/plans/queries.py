"""The library's queries over the test tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import catalogue, chunking, cycle, dialogue, evaluation, lexical, normalise, prompting, quality, ranking, regions, report, vectors
from ..sources import archive, pages
from ..sources.shared import cut
from . import stages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "lang", F.concat(F.lit("doc_"), "doc_id", F.lit(".txt")).alias("documento_origem"), F.col("source").alias("titulo_pagina"), F.col("text").alias("corpo"))


class Prepared:
    """What many queries read: written once a session and input folder, like an index that is built before it is searched."""

    _all: dict[tuple[str, str], Prepared] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Prepared:
        return cls._all.setdefault((spark.sparkContext.applicationId, sf_dir), cls(spark, sf_dir))

    @cached_property
    def passages(self) -> DataFrame:
        return cut(chunking.chunks(corpus(self.spark, self.sf_dir)))

    @cached_property
    def index(self) -> lexical.Index:
        return lexical.build(self.passages)

    @cached_property
    def vectors(self) -> DataFrame:
        return cut(vectors.hashed(self.passages))

    @cached_property
    def words(self) -> DataFrame:
        return cut(quality.page_words(_page_table(self.spark, self.sf_dir)))

    @cached_property
    def dictionary(self) -> DataFrame:
        seen = self.words.filter("minuscula and idioma <> 'deu'").groupBy("idioma", "palavra").agg(F.count_distinct("pagina").alias("n"))
        return cut(seen.filter("n >= 3").select("idioma", "palavra"))

    @cached_property
    def gold(self) -> DataFrame:
        return cut(_gold(self.spark, self.sf_dir))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Prepared.of(spark, sf_dir).passages


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("consulta_id"), F.col("text").alias("texto"))


# ── SQL building blocks ──
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
ONE_LINE = STRIP.format(r"regexp_replace({}, '\s+', ' ', 'g')")


def _pack(items: str, most: int, sep: str) -> str:
    last = "length(string_split(a, chr(1))[-1])"
    return f"list_filter(string_split(list_reduce(list_prepend('', {items}), lambda a, x: CASE WHEN {last} = 0 THEN a || x WHEN {last} + {len(sep)} + length(x) <= {most} THEN a || '{sep}' || x ELSE a || chr(1) || x END), chr(1)), lambda w: w <> '')"


def _giant(t: str, most: int) -> str:
    sentences = _pack(rf"string_split(regexp_replace({t}, '([.!?])\s+', '\1' || chr(2), 'g'), chr(2))", most, " ")
    words = f"flatten(list_transform({sentences}, lambda s: CASE WHEN length(s) > {most} THEN {_pack("string_split(s, ' ')", most, ' ')} ELSE [s] END))"
    slices = f"flatten(list_transform({words}, lambda v: CASE WHEN length(v) > {most} THEN list_transform(range(0, (length(v) + {most - 1}) // {most}), lambda i: substr(v, (i * {most} + 1)::BIGINT, {most})) ELSE [v] END))"
    return f"list_filter(list_transform({slices}, lambda y: {STRIP.format('y')}), lambda z: z <> '')"


def _docs(pattern: str) -> str:
    return rf"docs AS (SELECT doc_id, lang, 'doc_' || doc_id || '.txt' AS documento_origem, source AS titulo_pagina, list_transform(string_split_regex(text, '{pattern}'), lambda p: {STRIP.format('p')}) AS ps FROM documents)"


def _chunks(cut: str) -> str:
    return f"cut AS (SELECT *, {cut} AS cs FROM docs), chunks AS MATERIALIZED (SELECT documento_origem || '::' || (i - 1) AS chunk_id, cs[i] AS texto, documento_origem, titulo_pagina, (i - 1)::INT AS chunk_index FROM (SELECT *, unnest(range(1, len(cs) + 1)) AS i FROM cut))"


def _by_paragraph(least: int, most: int) -> str:
    return f"list_filter(flatten(list_transform(list_filter(ps, lambda p: length(p) >= {least}), lambda q: CASE WHEN length(q) <= {most} THEN [q] ELSE {_giant('q', most)} END)), lambda k: length(k) >= {least})"


def _grouped(least: int, most: int) -> str:
    """Runs of paragraphs that fit are packed between oversized ones, which come apart by themselves."""
    mark = f"list_transform(list_filter(ps, lambda p: p <> ''), lambda q: CASE WHEN length(q) > {most} THEN chr(3) || array_to_string({_giant('q', most)}, chr(1)) || chr(3) ELSE q END)"
    last = "length(string_split(a, chr(1))[-1])"
    fold = f"list_reduce(list_prepend('', {mark}), lambda a, x: CASE WHEN x[1] = chr(3) THEN a || chr(1) || replace(x, chr(3), '') || chr(1) WHEN {last} = 0 THEN a || x WHEN {last} + 2 + length(x) <= {most} THEN a || chr(10) || chr(10) || x ELSE a || chr(1) || x END)"
    return f"list_filter(string_split({fold}, chr(1)), lambda k: length(k) >= {least})"


BLANK = r"\n\s*\n"
BASE = f"WITH {_docs(BLANK)}, {_chunks(_grouped(60, 2000))}"
TOKENS = "list_filter(regexp_extract_all(lower({}), '[0-9a-zà-ÿ]+'), lambda t: length(t) >= 2)"
RANK = "row_number() OVER (PARTITION BY consulta_id ORDER BY round(score, 9) DESC, chunk_id)"


def _search(k: int, asked: str = "SELECT item_id AS consulta_id, text AS texto FROM benchmark", name: str = "lex") -> str:
    return f"""tok AS (SELECT chunk_id, unnest({TOKENS.format('texto')}) AS token FROM chunks),
post AS (SELECT token, chunk_id, count(*) AS tf FROM tok GROUP BY ALL),
size AS (SELECT chunk_id, len({TOKENS.format('texto')}) AS dl FROM chunks),
num AS (SELECT count(*) AS n, avg(dl) AS mean FROM size),
asked AS ({asked}), asked_tok AS (SELECT DISTINCT consulta_id, unnest({TOKENS.format('texto')}) AS token FROM asked),
freq AS (SELECT token, count(*) AS df FROM post GROUP BY token),
{name}_all AS (SELECT consulta_id, chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))) AS score FROM post JOIN asked_tok USING (token) JOIN freq USING (token) JOIN size USING (chunk_id), num GROUP BY ALL),
{name} AS MATERIALIZED (SELECT * FROM (SELECT consulta_id, {RANK} AS posicao, chunk_id, score FROM {name}_all) WHERE posicao <= {k})"""


def _dense(k: int) -> str:
    bucket = "('0x' || substr(md5(token), 1, 8))::BIGINT % 64"
    return f"""cv AS (SELECT chunk_id, {bucket} AS b, count(*)::DOUBLE AS n FROM tok GROUP BY ALL), cn AS (SELECT chunk_id, sqrt(sum(n * n)) AS m FROM cv GROUP BY ALL),
qv AS (SELECT consulta_id, {bucket} AS b, count(*)::DOUBLE AS n FROM (SELECT consulta_id, unnest({TOKENS.format('texto')}) AS token FROM asked) GROUP BY ALL), qn AS (SELECT consulta_id, sqrt(sum(n * n)) AS m FROM qv GROUP BY ALL),
den_all AS (SELECT consulta_id, chunk_id, sum(cv.n * qv.n) / (any_value(cn.m) * any_value(qn.m)) AS score FROM cv JOIN qv USING (b) JOIN cn USING (chunk_id) JOIN qn USING (consulta_id) GROUP BY ALL),
den AS (SELECT * FROM (SELECT consulta_id, {RANK} AS posicao, chunk_id, score FROM den_all) WHERE posicao <= {k})"""


BOTH = f"{BASE}, {_search(20)}, {_dense(20)}"
RESCALED = "res AS (SELECT l.consulta_id, l.posicao, l.chunk_id, CASE WHEN r.lo IS NULL THEN l.score ELSE coalesce(r.lo + (l.score - min(l.score) OVER q) / nullif(max(l.score) OVER q - min(l.score) OVER q, 0) * (r.hi - r.lo), r.hi) END AS score FROM lex l LEFT JOIN (SELECT consulta_id, min(score) AS lo, max(score) AS hi FROM den GROUP BY ALL) r USING (consulta_id) WINDOW q AS (PARTITION BY l.consulta_id))"
HYBRID = "fus AS (SELECT consulta_id, chunk_id, sum(w / (60 + posicao)) AS rrf, max(score) AS score FROM (SELECT *, 3.0 AS w FROM den UNION ALL SELECT *, 1.0 AS w FROM res) GROUP BY ALL), hyb AS (SELECT * FROM (SELECT consulta_id, row_number() OVER (PARTITION BY consulta_id ORDER BY round(rrf, 12) DESC, round(score, 9) DESC, chunk_id) AS posicao, chunk_id, score, rrf FROM fus) WHERE posicao <= 8)"


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    ready, q = Prepared.of(spark, sf_dir), questions(spark, sf_dir)
    return ready.passages, q, lexical.search(ready.index, q, 20), _dense_hits(spark, sf_dir)


def _dense_hits(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    return vectors.search(vectors.hashed(questions(spark, sf_dir), "consulta_id"), Prepared.of(spark, sf_dir).vectors, k)


def _out(r: DataFrame) -> DataFrame:
    return r.select("consulta_id", F.col("posicao").cast("long").alias("posicao"), "chunk_id", F.round("score", 6).alias("score"))


OUT = "consulta_id, posicao, chunk_id, round(score, 6) AS score"

# ── text functions ──


@query(r"SELECT doc_id, length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) AS uteis, length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) >= 50 AS tem_texto FROM documents")
def p1_useful_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", fn.useful_characters("text").alias("uteis"), fn.has_text("text").alias("tem_texto"))


@query(f"SELECT doc_id, CASE WHEN length(l) > 150 THEN l[1:150] || '...' ELSE l END AS previa, CASE WHEN length(l) > 400 THEN regexp_replace(l[1:400], '\\s+$', '') || '…' ELSE l END AS resumo FROM (SELECT doc_id, {ONE_LINE.format('text')} AS l FROM documents)")
def p2_p3_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", fn.preview("text").alias("previa"), fn.truncate("text", 400).alias("resumo"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(url, '[^\p{L}\p{N}_\-]+', '_', 'g'), '^_+|_+$', '', 'g') || '.txt' AS arquivo FROM pages")
def s4_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", fn.safe_file_name("url").alias("arquivo"))


@query(r"SELECT doc_id, source AS titulo, md5(text) AS corpo FROM documents")
def s6_header_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.concat(F.lit("# "), "source", F.lit("\n\n"), "text")
    d = table(spark, sf_dir, "documents").withColumn("c", content)
    return d.select("doc_id", fn.title_of("c").alias("titulo"), F.md5(fn.body_of("c")).alias("corpo"))


@query(rf"SELECT page_id, md5(CASE WHEN starts_with(upper(ltrim(html)), '#REDIRECT') THEN '' ELSE {STRIP.format(chr(114) + "egexp_replace(regexp_replace('a<ref name=x/>b' || html || '<REF>no' || chr(10) || 'te</ref >' || '<ref>x</ref>', '(?is)<ref[^>]*/>', '', 'g'), '(?is)<ref[^>]*>.*?</ref>', '', 'g')")} END) AS texto FROM pages")
def s3_markup_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.concat(F.lit("a<ref name=x/>b"), "html", F.lit("<REF>no\nte</ref >"), F.lit("<ref>x</ref>"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(fn.clean_markup_notes(noisy)).alias("texto"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fra' WHEN 'es' THEN 'spa' WHEN 'de' THEN 'deu' WHEN 'pt' THEN 'por' WHEN 'it' THEN 'ita' ELSE '' END AS idioma FROM documents")
def s11_tool_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", fn.tool_language(F.concat(F.upper("lang"), F.lit("-XX"))).alias("idioma"))


@query("SELECT vec_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || lower(printf('%x', (('0x' || h[17])::INT & 3) | 8)) || h[18:20] || '-' || h[21:32] AS ponto_id FROM (SELECT vec_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(vec_id::VARCHAR)) AS h FROM embeddings)")
def h_point_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", fn.point_id(F.col("vec_id").cast("string")).alias("ponto_id"))


@query(f"SELECT doc_id, len(t) AS tokens, len(list_distinct(t)) AS distintos, md5(array_to_string(t, ' ')) AS texto FROM (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents)")
def t1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", fn.tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").alias("tokens"), F.size(F.array_distinct("t")).alias("distintos"), F.md5(F.array_join("t", " ")).alias("texto"))


# ── passages ──
CHUNK_OUT = "SELECT chunk_id, md5(texto) AS texto, length(texto) AS n, titulo_pagina, chunk_index FROM chunks"


def _chunk_out(c: DataFrame) -> DataFrame:
    return c.select("chunk_id", F.md5("texto").alias("texto"), F.length("texto").alias("n"), "titulo_pagina", "chunk_index")


@query(f"{BASE} {CHUNK_OUT}")
def c5_grouped_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_out(passages(spark, sf_dir))


@query(f"WITH {_docs(BLANK)}, {_chunks(_by_paragraph(60, 2000))} {CHUNK_OUT}")
def c4_paragraph_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_out(chunking.chunks(corpus(spark, sf_dir), "paragrafo"))


@query(f"WITH {_docs(chr(92) + 'n')}, {_chunks(_grouped(20, 300))} {CHUNK_OUT}")
def c2_c3_small_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_out(chunking.chunks(corpus(spark, sf_dir), "paragrafo_agrupado", 20, 300, r"\n"))


@query(f"{BASE} SELECT count(*) AS trechos, count(DISTINCT documento_origem) AS documentos, min(length(texto)) AS menor, floor(sum(length(texto)) / count(*))::BIGINT AS media, max(length(texto)) AS maior, count(*) FILTER (length(texto) > 2000) AS acima_do_teto FROM chunks")
def c8_corpus_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.statistics(passages(spark, sf_dir))


# ── retrieval ──


@query(f"{BASE}, {_search(8)} SELECT token, df, cf FROM (SELECT token, count(*) AS df, sum(tf)::BIGINT AS cf FROM post GROUP BY token)")
def t2_index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Prepared.of(spark, sf_dir).index.terms


@query(f"{BASE}, {_search(8)} SELECT {OUT} FROM lex")
def t3_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(lexical.search(Prepared.of(spark, sf_dir).index, questions(spark, sf_dir), 8))


@query(f"{BOTH} SELECT {OUT} FROM den")
def t4_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(_dense_hits(spark, sf_dir))


@query(f"{BOTH}, fus AS (SELECT consulta_id, chunk_id, sum(1 / (60 + posicao)) AS rrf, max(score) AS score FROM (SELECT * FROM den UNION ALL SELECT * FROM lex) GROUP BY ALL) SELECT consulta_id, row_number() OVER (PARTITION BY consulta_id ORDER BY round(rrf, 12) DESC, round(score, 9) DESC, chunk_id) AS posicao, chunk_id, round(score, 6) AS score FROM fus")
def t9_rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, lex, den = _both(spark, sf_dir)
    return _out(ranking.fuse(den.unionByName(lex)))


@query(f"{BOTH}, {RESCALED} SELECT {OUT} FROM res")
def t10_rescaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, lex, den = _both(spark, sf_dir)
    return _out(ranking.rescale(lex, den))


@query(f"{BOTH}, {RESCALED}, {HYBRID} SELECT {OUT} FROM hyb")
def t11_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, lex, den = _both(spark, sf_dir)
    return _out(ranking.hybrid(den, lex))


@query(f"{BOTH} SELECT consulta_id, row_number() OVER (PARTITION BY consulta_id ORDER BY posicao) AS posicao, chunk_id, round(score, 6) AS score FROM (SELECT d.*, row_number() OVER (PARTITION BY consulta_id, titulo_pagina ORDER BY posicao) AS nth FROM den d JOIN chunks USING (chunk_id)) WHERE nth <= 2")
def t12_cap_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, _, _, den = _both(spark, sf_dir)
    r = den.join(p.select("chunk_id", F.col("titulo_pagina").alias("documento_origem")), "chunk_id")
    return _out(ranking.cap_by_document(r, 2))


CUT = "SELECT *, first(score) OVER w AS top FROM den WINDOW w AS (PARTITION BY consulta_id ORDER BY posicao)"


@query(f"{BOTH}, t AS ({CUT}), u AS (SELECT *, top <= 0 OR score >= 0.9 * top AS ok FROM t), v AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY consulta_id) AS n FROM u) SELECT {OUT} FROM v WHERE CASE WHEN n >= 5 THEN ok ELSE posicao <= 5 END")
def t6_t7_quantity_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(ranking.decide_quantity(_dense_hits(spark, sf_dir)))


NOTE = f"coalesce(len(list_intersect(list_distinct({TOKENS.format('a.texto')}), {TOKENS.format('c.texto')})) / nullif(len(list_distinct({TOKENS.format('a.texto')})), 0), 0)"


@query(f"{BOTH} SELECT consulta_id, row_number() OVER (PARTITION BY consulta_id ORDER BY round(nota, 9) DESC, chunk_id) AS posicao, chunk_id, round(score, 6) AS score FROM (SELECT d.consulta_id, d.chunk_id, d.score, {NOTE} AS nota FROM den d JOIN chunks c USING (chunk_id) JOIN asked a USING (consulta_id))")
def t8_reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, q, _, den = _both(spark, sf_dir)
    r = den.join(p.select("chunk_id", "texto"), "chunk_id").join(q.select("consulta_id", F.col("texto").alias("q")), "consulta_id")
    return _out(ranking.rerank(r, ranking.overlap("q", "texto")))


SUBS = "SELECT item_id * 2 + s AS consulta_id, CASE s WHEN 0 THEN text[1:(length(text) // 2)] ELSE text[(length(text) // 2 + 1):] END AS texto FROM benchmark, (SELECT unnest([0, 1]) AS s)"


@query(f"{BASE}, {_search(20, SUBS)}, fus AS (SELECT consulta_id // 2 AS consulta_id, chunk_id, sum(1 / (60 + posicao)) AS rrf, max(score) AS score FROM lex GROUP BY ALL), ord AS (SELECT *, row_number() OVER (PARTITION BY consulta_id ORDER BY round(rrf, 12) DESC, round(score, 9) DESC, chunk_id) AS p FROM fus), re AS (SELECT o.consulta_id, o.chunk_id, o.score, {NOTE} AS nota FROM ord o JOIN chunks c USING (chunk_id) JOIN (SELECT item_id AS consulta_id, text AS texto FROM benchmark) a USING (consulta_id) WHERE p <= 50) SELECT * FROM (SELECT consulta_id, row_number() OVER (PARTITION BY consulta_id ORDER BY round(nota, 9) DESC, chunk_id) AS posicao, chunk_id, round(score, 6) AS score FROM re) WHERE posicao <= 8")
def t17_mediated_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, q = passages(spark, sf_dir), questions(spark, sf_dir)
    half = F.floor(F.length("texto") / 2).cast("int")
    parts = F.array(F.substring("texto", F.lit(1), half), F.substring("texto", half + 1, F.length("texto")))
    subs = q.select(F.col("consulta_id").alias("q"), F.posexplode(parts).alias("s", "texto")).withColumn("consulta_id", F.col("q") * 2 + F.col("s"))
    pools = lexical.search(Prepared.of(spark, sf_dir).index, subs, 20).withColumn("consulta_id", F.floor(F.col("consulta_id") / 2).cast("long"))
    return _out(ranking.mediate(pools, p, q))


@query("SELECT label, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], f::DOUBLE[]), 6) AS cosseno FROM (SELECT *, first(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS f FROM embeddings)")
def t13_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("f"))
    return e.join(first, "label").select("label", "vec_id", F.round(vectors.cosine("embedding", "f"), 6).alias("cosseno"))


@query()
def t14_redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    den = _dense_hits(spark, sf_dir)
    items = den.join(Prepared.of(spark, sf_dir).vectors, "chunk_id").select("consulta_id", F.col("posicao").alias("ordem"), "chunk_id", "vetor")
    return vectors.drop_redundant(items, 0.9).select("consulta_id", "ordem", "chunk_id")


@query()
def t19_diversified(spark: SparkSession, sf_dir: str) -> DataFrame:
    den = _dense_hits(spark, sf_dir)
    return _out(ranking.mmr(den.join(Prepared.of(spark, sf_dir).vectors, "chunk_id"), 5))


# ── prompts ──
HITS = f"{BASE}, {_search(20)}, hit AS (SELECT l.*, titulo_pagina, texto FROM lex l JOIN chunks USING (chunk_id))"
COST = "ceil(length('[Fonte 00: ' || titulo_pagina || ']' || chr(10) || texto || chr(10) || chr(10)) / 4.0)::BIGINT"


def _hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p, q = passages(spark, sf_dir), questions(spark, sf_dir)
    return q, cycle.with_passages(lexical.search(Prepared.of(spark, sf_dir).index, q, 20), p)


@query(f"{HITS} SELECT consulta_id, posicao, chunk_id, custo, acumulado FROM (SELECT *, sum(custo) OVER (PARTITION BY consulta_id ORDER BY posicao)::BIGINT AS acumulado FROM (SELECT *, {COST} AS custo FROM hit)) WHERE posicao = 1 OR acumulado <= 1900")
def g1_g2_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = prompting.fit_budget(_hits(spark, sf_dir)[1], 2000, 100)
    return r.select("consulta_id", F.col("posicao").cast("long").alias("posicao"), "chunk_id", F.col("custo").cast("long").alias("custo"), F.col("acumulado").cast("long").alias("acumulado"))


@query(f"{HITS}, b AS (SELECT consulta_id, count(*) AS n, string_agg('[Fonte ' || posicao || ': ' || titulo_pagina || ']' || chr(10) || texto, chr(10) || chr(10) ORDER BY CASE WHEN posicao % 2 = 1 THEN posicao ELSE 1000 - posicao END) AS t FROM hit WHERE posicao <= 5 GROUP BY consulta_id) SELECT consulta_id, md5('{prompting.INSTRUCTION}' || chr(10) || chr(10) || 'TRECHOS RECUPERADOS:' || chr(10) || t || chr(10) || chr(10) || 'PERGUNTA:' || chr(10) || text) AS prompt, n FROM b JOIN benchmark ON item_id = consulta_id")
def g4_g5_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, r = _hits(spark, sf_dir)
    return prompting.prompts(q, r.filter("posicao <= 5")).select("consulta_id", F.md5("prompt").alias("prompt"), "n")


@query("SELECT conv_id, turn, array_to_string(list_transform(list_filter([turn - 1, turn + 2, turn], lambda i: i = 0 OR i > 4), lambda j: 'Fonte ' || j), ', ') AS invalidas FROM conversations")
def g6_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    n = lambda k: (F.col("turn") + k).cast("string")
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" [Fonte "), n(-1), F.lit(": a, FONTE  "), n(2), F.lit("] e fonte "), n(0))
    return c.select("conv_id", "turn", F.array_join(prompting.invalid_citations(text, 4), ", ").alias("invalidas"))


# ── conversation ──
EXCHANGE = "x AS (SELECT conv_id, turn, text AS pergunta, coalesce(CASE WHEN r = 'assistant' THEN t END, '') AS resposta, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS troca FROM (SELECT *, lead(role) OVER w AS r, lead(text) OVER w AS t FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user')"
ANSWER = f"CASE WHEN resposta = '' THEN '' ELSE chr(10) || 'Resposta: ' || (CASE WHEN length({ONE_LINE.format('resposta')}) > 600 THEN regexp_replace({ONE_LINE.format('resposta')}[1:600], '\\s+$', '') || '…' ELSE {ONE_LINE.format('resposta')} END) END"


@query(f"WITH {EXCHANGE} SELECT conv_id, turn, troca, md5(pergunta) AS pergunta, md5(coalesce(string_agg('Pergunta: ' || pergunta || {ANSWER}, chr(10) || chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '')) AS historico FROM x")
def d3_d4_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = dialogue.memory(dialogue.exchanges(table(spark, sf_dir, "conversations")))
    return m.select("conv_id", "turn", F.col("troca").cast("long").alias("troca"), F.md5("pergunta").alias("pergunta"), F.md5("historico").alias("historico"))


CUES = "CASE conv_id % 5 WHEN 0 THEN 'Escreva um texto: ' WHEN 1 THEN ' Quem foi ' WHEN 2 THEN 'isto pede que gere um plano ' WHEN 3 THEN 'quando ' ELSE '' END || coalesce(text, '')"


def _kind_sql(t: str) -> str:
    product = " OR ".join(f"starts_with({t}, '{c}') OR contains({t}, ' {c}')" for c in dialogue.PRODUCT_CUES)
    fact = " OR ".join(f"starts_with({t}, '{c}')" for c in dialogue.FACT_CUES)
    return f"CASE WHEN {product} THEN 'produto_acabado' WHEN {fact} THEN 'duvida_factual' ELSE 'indefinido' END"


@query(f"SELECT conv_id, turn, tipo, CASE WHEN tipo <> 'duvida_factual' THEN 'problematizacao' ELSE 'recuperacao' END AS estado FROM (SELECT conv_id, turn, CASE WHEN p = 'produto_acabado' OR turn % 3 = 2 THEN p WHEN turn % 3 = 0 THEN 'duvida_factual' ELSE 'exploracao' END AS tipo FROM (SELECT conv_id, turn, {_kind_sql('t')} AS p FROM (SELECT conv_id, turn, lower({STRIP.format(f'({CUES})')}) AS t FROM conversations)))")
def d5_d7_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    lead = F.element_at(F.array(*map(F.lit, ("Escreva um texto: ", " Quem foi ", "isto pede que gere um plano ", "quando ", ""))), (F.col("conv_id") % 5 + 1).cast("int"))
    model = F.element_at(F.array(*map(F.lit, ("  Duvida factual.", "EXPLORACAO", "não sei"))), (F.col("turn") % 3 + 1).cast("int"))
    kind = dialogue.final_kind(F.concat(lead, F.coalesce("text", F.lit(""))), model)
    return c.select("conv_id", "turn", kind.alias("tipo"), dialogue.next_state(kind, F.lit(True)).alias("estado"))


@query(r"SELECT conv_id, turn, CASE WHEN length(t) BETWEEN 4 AND 200 THEN t ELSE '' END AS consultas FROM (SELECT conv_id, turn, regexp_replace(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS t FROM conversations)".replace("THEN t ELSE", "AND NOT (" + " OR ".join(f"contains(lower(t), '{e}')" for e in dialogue.ECHOES) + ") THEN t ELSE"))
def t15_sub_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("t", fn.one_line(F.coalesce("text", F.lit(""))))
    reply = F.concat(F.lit("Aqui estão as consultas:\n1. "), "t", F.lit("\n2) "), F.upper("t"), F.lit("\n- ok\n* QUESTION\n"))
    subs = dialogue.sub_questions(reply, F.lit("question"), 4)
    return c.select("conv_id", "turn", F.coalesce(F.try_element_at(subs, F.lit(1)), F.lit("")).alias("consultas"))


@query(r"SELECT conv_id, turn, CASE WHEN length(t) + 1 BETWEEN 10 AND 300 THEN t || '?' ELSE '' END AS perguntas FROM (SELECT conv_id, turn, regexp_replace(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS t FROM conversations)")
def d8_returned_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("t", fn.one_line(F.coalesce("text", F.lit(""))))
    reply = F.concat(F.lit("sem ponto de pergunta\n1. "), "t", F.lit("?\n2. "), F.lower("t"), F.lit("?\ncurta?"))
    return c.select("conv_id", "turn", F.array_join(dialogue.returned_questions(reply), "|").alias("perguntas"))


@query(r"SELECT conv_id, turn, CASE WHEN t = '' OR length(t) > greatest(40, 170) THEN '' ELSE t END AS consulta FROM (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), '^[" + "\"''“”" + r"]+|[" + "\"''“”" + r"]+$', '', 'g') AS t FROM conversations)")
def d2_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("t", fn.one_line(F.coalesce("text", F.lit(""))))
    reply = F.concat(F.lit('\n-> pergunta: "'), "t", F.lit('"\n'))
    return c.select("conv_id", "turn", dialogue.rewritten(reply, F.lit("0123456789")).alias("consulta"))


@query("SELECT conv_id::VARCHAR AS sessao_id, 'inicio' || coalesce(string_agg(CASE WHEN role = 'user' AND turn >= 2 AND regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '' THEN chr(10) || regexp_replace(text, '^\\s+|\\s+$', '', 'g') END, '' ORDER BY turn), '') AS consulta FROM conversations GROUP BY conv_id")
def d10_consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    t = c.select(F.col("conv_id").cast("string").alias("sessao_id"), F.col("turn").alias("ordem"), F.when(F.col("role") == "user", "pessoa").otherwise("sistema").alias("autor"), F.col("text").alias("texto"), F.when(F.col("turn") >= 2, "problematizacao").otherwise("triagem").alias("estado"), F.lit("inicio").alias("pergunta_inicial"))
    return dialogue.consolidated(t)


ESCAPED = ", ".join(f"'{e}'" for e in dialogue.ESCAPES)
ASKS = rf"list_bool_or(list_transform(string_split_regex(coalesce(text, ''), '\r\n|\r|\n'), lambda x: contains(x, '?') AND length({STRIP.format(rf"regexp_replace({STRIP.format(rf"regexp_replace(x, '^\s*(\d+[.)\]]|[-*•–—])\s*', '')")}, '^\x22+|\x22+$', '', 'g')")}) BETWEEN 10 AND 300))"
STATES = f"""WITH e AS (SELECT conv_id, turn, role = 'user' AS p, coalesce(text, '') AS t, {STRIP.format("coalesce(text, '')")} AS s, coalesce({ASKS}, FALSE) AS q, {_kind_sql("lower(" + STRIP.format("coalesce(text, '')") + ")")} = 'duvida_factual' AS f, turn % 4 < 2 AS n FROM conversations),
g AS (SELECT conv_id, list({{'p': p, 't': t, 's': s, 'q': q, 'f': f, 'n': n, 'e': '', 'r': 0, 'c': ''}} ORDER BY turn) AS l FROM e GROUP BY conv_id),
d AS (SELECT conv_id, list_reduce(list_prepend({{'p': TRUE, 't': '', 's': '', 'q': FALSE, 'f': FALSE, 'n': FALSE, 'e': 'triagem', 'r': 0, 'c': ''}}, l), lambda a, x: {{'p': x.p, 't': x.t, 's': x.s, 'q': x.q, 'f': x.f, 'n': x.n,
'e': CASE WHEN a.e = 'triagem' AND x.p THEN CASE WHEN x.f THEN 'recuperacao' ELSE 'problematizacao' END
WHEN a.e = 'problematizacao' AND x.p THEN CASE WHEN x.s = '' OR lower(x.s) IN ({ESCAPED}) OR a.r >= 1 THEN 'recuperacao' ELSE a.e END
WHEN a.e = 'problematizacao' THEN CASE WHEN x.q THEN a.e ELSE 'recuperacao' END
WHEN a.e = 'recuperacao' AND NOT x.p THEN CASE WHEN x.n THEN 'resposta' ELSE 'encerrada' END
WHEN a.e = 'resposta' AND NOT x.p THEN 'encerrada' ELSE a.e END,
'r': a.r + (a.e = 'problematizacao' AND NOT x.p AND x.q)::INT,
'c': CASE WHEN a.e = 'triagem' AND x.p THEN x.t WHEN a.e = 'problematizacao' AND x.p AND NOT (x.s = '' OR lower(x.s) IN ({ESCAPED})) THEN a.c || chr(10) || x.s ELSE a.c END}}) AS z FROM g)
SELECT conv_id::VARCHAR AS sessao_id, z.e AS estado, z.r AS rodadas, md5(z.c) AS consulta FROM d"""


@query(STATES)
def d9_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    author = F.when(F.col("role") == "user", "pessoa").otherwise("sistema")
    events = c.select(F.col("conv_id").cast("string").alias("sessao_id"), F.col("turn").alias("ordem"), author.alias("autor"), F.col("text").alias("texto"), F.when(F.col("turn") % 4 < 2, 5).otherwise(0).alias("trechos"))
    return dialogue.sessions(events).withColumn("consulta", F.md5("consulta"))


# What a provider might answer: two numbered lines, nothing readable, or no answer at all.
HALVES = f"SELECT item_id, t, CASE WHEN item_id % 5 = 0 THEN NULL WHEN item_id % 5 = 1 THEN ['ok'] ELSE [{STRIP.format('t[1:60]')}, {STRIP.format('t[61:120]')}] END AS o, item_id % 7 <> 0 AS ligada, item_id % 4 <> 3 AS parte, CASE WHEN item_id % 3 = 0 THEN 'en' ELSE '' END AS lingua FROM (SELECT item_id, {ONE_LINE.format('text')} AS t FROM benchmark)"


@query(f"WITH h AS ({HALVES}), v AS (SELECT *, list_filter(o, lambda x: length(x) BETWEEN 4 AND 200 AND lower(x) <> lower(t) AND NOT ({' OR '.join(f"contains(lower(x), '{e}')" for e in dialogue.ECHOES)})) AS u FROM h), w AS (SELECT *, CASE WHEN len(u) = 2 AND lower(u[1]) = lower(u[2]) THEN u[1:1] ELSE u END AS d FROM v), m AS (SELECT *, CASE WHEN NOT ligada THEN 'mediação desligada' WHEN NOT parte AND lingua = '' THEN 'nada a preparar: sem decomposição nem tradução' WHEN parte AND lingua = '' AND length(t) < 25 THEN 'pergunta curta demais para valer uma reformulação' WHEN o IS NULL THEN 'o modelo não respondeu' WHEN len(d) = 0 THEN 'o modelo não devolveu consulta legível' ELSE '' END AS motivo FROM w) SELECT item_id AS consulta_id, md5(array_to_string(CASE WHEN motivo = '' THEN list_concat([t], CASE WHEN parte THEN d ELSE d[1:1] END) ELSE [t] END, '|')) AS subconsultas, motivo = '' AS veio_do_modelo, motivo FROM m")
def t16_decomposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "benchmark").select("item_id", fn.one_line("text").alias("t"))
    i = F.col("item_id")
    lines = F.concat(F.lit("1. "), F.substring("t", 1, 60), F.lit("\n2) "), F.substring("t", 61, 60))
    said = F.when(i % 5 == 0, F.lit(None).cast("string")).when(i % 5 == 1, F.lit("ok")).otherwise(lines)
    d = dialogue.decompose(F.col("t"), said, i % 7 != 0, i % 4 != 3, F.when(i % 3 == 0, F.lit("en")).otherwise(F.lit("")))
    return q.withColumn("d", d).select(i.alias("consulta_id"), F.md5(F.array_join("d.subconsultas", "|")).alias("subconsultas"), F.col("d.veio_do_modelo").alias("veio_do_modelo"), F.col("d.motivo").alias("motivo"))


@query(f"WITH {EXCHANGE}, y AS (SELECT conv_id, turn, coalesce(pergunta, '') AS pergunta, troca, {ONE_LINE.format("coalesce(pergunta, '')")} AS t FROM x), z AS (SELECT *, CASE WHEN troca <= 1 THEN 'primeira pergunta da conversa' WHEN conv_id % 4 = 0 THEN 'o modelo não respondeu' WHEN conv_id % 4 = 1 THEN 'o modelo não devolveu reescrita aproveitável' ELSE '' END AS motivo FROM y) SELECT conv_id, turn, md5(CASE WHEN motivo = '' THEN 'Sobre ' || t ELSE pergunta END) AS consulta, motivo = '' AS veio_do_modelo, motivo FROM z")
def d1_rewrite_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = dialogue.exchanges(table(spark, sf_dir, "conversations")).withColumn("pergunta", F.coalesce("pergunta", F.lit("")))
    m = F.col("conv_id") % 4
    said = F.when(m == 0, F.lit(None).cast("string")).when(m == 1, F.lit(" \n")).otherwise(F.concat(F.lit('-> "Sobre '), fn.one_line("pergunta"), F.lit('"')))
    d = dialogue.rewrite(F.col("pergunta"), F.col("troca") - 1, said)
    return x.withColumn("d", d).select("conv_id", "turn", F.md5("d.consulta").alias("consulta"), F.col("d.veio_do_modelo").alias("veio_do_modelo"), F.col("d.motivo").alias("motivo"))


# ── evaluation ──
GOLD = f"{BASE}, {_search(20)}, gold AS MATERIALIZED (SELECT item_id AS consulta_id, CASE WHEN item_id % 2 = 0 THEN 'factual' ELSE 'exploratoria' END AS tipo, titulo AS pagina FROM benchmark LEFT JOIN (SELECT DISTINCT item_id AS i, source AS titulo FROM benchmark, documents WHERE contains(documents.text, benchmark.text)) ON i = item_id)"
CASES = "pg AS (SELECT consulta_id, pagina, row_number() OVER (PARTITION BY consulta_id ORDER BY m) AS lugar FROM (SELECT consulta_id, titulo_pagina AS pagina, min(posicao) AS m FROM {r} JOIN chunks USING (chunk_id) GROUP BY ALL)), cs AS (SELECT g.consulta_id, tipo, esperadas, coalesce(acertos, 0) AS acertos, coalesce(coalesce(acertos, 0) / nullif(esperadas, 0), 0) AS cobertura, primeira, coalesce(trechos, 0) AS trechos FROM (SELECT consulta_id, any_value(tipo) AS tipo, count(DISTINCT pagina) AS esperadas FROM gold GROUP BY ALL) g LEFT JOIN (SELECT consulta_id, count(*) AS acertos, min(lugar) AS primeira FROM gold JOIN pg USING (consulta_id, pagina) GROUP BY ALL) USING (consulta_id) LEFT JOIN (SELECT consulta_id, count(*) AS trechos FROM {r} GROUP BY ALL) USING (consulta_id))"


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of documents that hold a benchmark passage: found by the passage's first five words, then checked whole."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("consulta_id"), F.col("text").alias("b"))
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("text").alias("d"))
    word = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")

    def runs(c: Column) -> Column:
        return fn.let(word(c), lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 4, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(w, i, 5), " "))))

    # The passage's second to sixth words: its first may be only the end of a longer word in a document.
    inner = b.select("consulta_id", "b", F.xxhash64(F.array_join(F.slice(word(F.col("b")), 2, 5), " ")).alias("h"))
    keys = d.select("doc_id", F.explode(F.array_distinct(runs(F.col("d")))).alias("h"))
    found = keys.join(inner, "h").select("doc_id", "consulta_id").distinct()
    pairs = found.join(d, "doc_id").join(b, "consulta_id").filter(F.contains("d", "b")).select("consulta_id", F.col("source").alias("pagina")).distinct()
    kind = F.when(F.col("consulta_id") % 2 == 0, "factual").otherwise("exploratoria")
    return b.select("consulta_id", kind.alias("tipo")).join(pairs, "consulta_id", "left")


def _case_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready, q = Prepared.of(spark, sf_dir), questions(spark, sf_dir)
    return evaluation.run(q, ready.gold, lambda asked: lexical.search(ready.index, asked, 20).join(ready.passages.select("chunk_id", "titulo_pagina"), "chunk_id"))


@query(f"{GOLD}, {CASES.format(r='lex')} SELECT consulta_id, tipo, esperadas, acertos, round(cobertura, 6) AS cobertura, primeira, trechos FROM cs")
def e1_e2_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _case_table(spark, sf_dir).withColumn("cobertura", F.round("cobertura", 6)).withColumn("primeira", F.col("primeira").cast("long"))


@query(f"{GOLD}, {CASES.format(r='lex')} SELECT count(*) AS casos, round(avg((acertos > 0)::INT), 6) AS recall, round(avg(cobertura), 6) AS cobertura, round(avg(coalesce(1 / primeira, 0)), 6) AS mrr, round(avg(trechos), 6) AS trechos_por_caso FROM cs")
def e3_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = evaluation.summary(_case_table(spark, sf_dir))
    return s.select("casos", *[F.round(c, 6).alias(c) for c in s.columns[1:]])


@query(f"{GOLD}, {CASES.format(r='lex')} SELECT tipo, count(*) AS casos, round(avg((acertos > 0)::INT), 6) AS recall FROM cs GROUP BY tipo")
def e4_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.by_kind(_case_table(spark, sf_dir)).withColumn("recall", F.round("recall", 6))


SECOND = CASES.format(r="den").replace("pg AS", "pg2 AS").replace("cs AS", "cs2 AS").replace("JOIN pg USING", "JOIN pg2 USING")


@query(f"{GOLD}, {CASES.format(r='lex')}, {_dense(20)}, {SECOND} SELECT consulta_id, cs.primeira::BIGINT AS antes, cs2.primeira::BIGINT AS depois, coalesce(cs2.primeira, 1073741824) > coalesce(cs.primeira, 1073741824) AS piorou FROM cs JOIN cs2 USING (consulta_id) WHERE cs.primeira IS DISTINCT FROM cs2.primeira")
def e6_compared_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, _, lex, den = _both(spark, sf_dir)
    titles = p.select("chunk_id", "titulo_pagina")
    gold = Prepared.of(spark, sf_dir).gold
    return evaluation.compare(evaluation.cases(gold, lex.join(titles, "chunk_id")), evaluation.cases(gold, den.join(titles, "chunk_id"))).withColumns({c: F.col(c).cast("long") for c in ("antes", "depois")})


MEANS = "count(*) AS casos, round(avg((acertos > 0)::INT), 6) AS recall, round(avg(cobertura), 6) AS cobertura, round(avg(coalesce(1 / primeira, 0)), 6) AS mrr, round(avg(trechos), 6) AS trechos_por_caso"


@query(f"{GOLD}, {CASES.format(r='lex')}, {_dense(20)}, {SECOND}, s AS (SELECT 'lexica' AS rotulo, {MEANS} FROM cs UNION ALL SELECT 'densa', {MEANS} FROM cs2) SELECT s.*, round(recall - (SELECT recall FROM s WHERE rotulo = 'lexica'), 6) AS diferenca FROM s")
def e5_e8_side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready, q = Prepared.of(spark, sf_dir), questions(spark, sf_dir)
    titles = ready.passages.select("chunk_id", "titulo_pagina")
    lex = evaluation.run(q, ready.gold, lambda asked: lexical.search(ready.index, asked, 20).join(titles, "chunk_id"))
    den = evaluation.run(q, ready.gold, lambda asked: vectors.search(vectors.hashed(asked, "consulta_id"), ready.vectors, 20).join(titles, "chunk_id"))
    s = evaluation.side_by_side(lex, den, ("lexica", "densa"))
    return s.select("rotulo", "casos", *[F.round(c, 6).alias(c) for c in ("recall", "cobertura", "mrr", "trechos_por_caso", "diferenca")])


FIT = f"over_ AS (SELECT item_id AS consulta_id, ceil(length('{prompting.INSTRUCTION}' || chr(10) || chr(10) || 'TRECHOS RECUPERADOS:' || chr(10) || chr(10) || chr(10) || 'PERGUNTA:' || chr(10) || text) / 4.0)::BIGINT AS o FROM benchmark), fit AS (SELECT * FROM (SELECT l.*, titulo_pagina, texto, o, sum({COST}) OVER (PARTITION BY consulta_id ORDER BY posicao) AS acumulado FROM lex l JOIN chunks USING (chunk_id) JOIN over_ USING (consulta_id)) WHERE posicao = 1 OR acumulado <= 1500 - o)"


@query(f"{GOLD}, {CASES.format(r='lex')}, {FIT}, k AS (SELECT consulta_id, count(*) AS n FROM fit GROUP BY ALL), h AS (SELECT DISTINCT g.consulta_id FROM gold g JOIN fit f ON f.consulta_id = g.consulta_id AND f.titulo_pagina = g.pagina) SELECT {MEANS}, count(*) FILTER (coalesce(n, 0) < trechos) AS casos_cortados, round(avg((h.consulta_id IS NOT NULL)::INT), 6) AS recall_no_prompt FROM cs LEFT JOIN k USING (consulta_id) LEFT JOIN h ON h.consulta_id = cs.consulta_id")
def e3_e5_in_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready, q = Prepared.of(spark, sf_dir), questions(spark, sf_dir)
    search = lambda asked: cycle.with_passages(lexical.search(ready.index, asked, 20), ready.passages)
    s = evaluation.summary(evaluation.run(q, ready.gold, search, fit=lambda asked, hits: cycle.fitting(asked, hits, 1500)))
    return s.select("casos", *[F.round(c, 6).alias(c) for c in s.columns[1:5]], "casos_cortados", F.round("recall_no_prompt", 6).alias("recall_no_prompt"))


PROMPT = f"'{prompting.INSTRUCTION}' || chr(10) || chr(10) || 'TRECHOS RECUPERADOS:' || chr(10) || t || chr(10) || chr(10) || 'PERGUNTA:' || chr(10) || text"


@query(f"{BASE}, {_search(20)}, {FIT}, b AS (SELECT consulta_id, count(*) AS n, string_agg('[Fonte ' || posicao || ': ' || titulo_pagina || ']' || chr(10) || texto, chr(10) || chr(10) ORDER BY CASE WHEN posicao % 2 = 1 THEN posicao ELSE 1000 - posicao END) AS t FROM fit GROUP BY consulta_id) SELECT item_id AS consulta_id, coalesce(n, 0) AS trechos, md5({PROMPT}) AS prompt, 'Conforme a Fonte 1, ' || length({PROMPT}) || ' caracteres de contexto.' AS resposta, CASE WHEN n IS NOT NULL THEN 0 END AS invalidas FROM benchmark LEFT JOIN b ON consulta_id = item_id")
def g3_g7_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, hits = _hits(spark, sf_dir)
    a = cycle.answer(q, hits, budget=1500)
    return a.select("consulta_id", F.col("trechos").cast("long").alias("trechos"), F.md5("prompt").alias("prompt"), "resposta", F.size("citacoes_invalidas").alias("invalidas")).withColumn("invalidas", F.when(F.col("prompt").isNotNull(), F.col("invalidas")))


# ── page quality ──
EDGE = "[" + "".join("\\" + x if x in "[]-" else "''" if x == "'" else x for x in fn.EDGE_PUNCTUATION) + "]+"
WORDS = rf"list_filter(list_transform(string_split_regex(text, '\s+'), lambda w: regexp_replace(w, '^{EDGE}|{EDGE}$', '', 'g')), lambda v: regexp_matches(v, '^\p{{L}}+$'))"
LANG = "CASE lang WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fra' WHEN 'es' THEN 'spa' ELSE 'deu' END"
QUALITY = rf"""WITH pg AS (SELECT source AS handle, source || '.pdf' AS arquivo, doc_id AS pagina, {LANG} AS idioma, CASE doc_id % 4 WHEN 0 THEN 'digital_nativo' WHEN 2 THEN 'ocr_anterior' ELSE 'ocr' END AS origem, text, {WORDS} AS ws FROM documents),
w AS (SELECT handle, arquivo, pagina, idioma, i AS pos, ws[i] AS palavra, regexp_matches(ws[i], '^\p{{Ll}}') AS mi, regexp_matches(ws[i], '^\p{{Lu}}') AS ma FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM pg)),
dic AS (SELECT idioma, palavra FROM w WHERE mi AND idioma <> 'deu' GROUP BY ALL HAVING count(DISTINCT pagina) >= 3),
k AS (SELECT w.*, CASE WHEN idioma <> 'deu' THEN dic.palavra IS NULL END AS des FROM w LEFT JOIN dic USING (idioma, palavra)),
ind AS (SELECT handle, arquivo, pagina, count(*) AS palavras, avg(des::INT) FILTER (mi) AS fora, sum((ma AND des)::INT) FILTER (des IS NOT NULL) AS nomes FROM k GROUP BY ALL),
page AS (SELECT handle, arquivo, pagina, origem, length(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g')) AS caracteres, coalesce(palavras, 0) AS palavras, fora, nomes FROM pg LEFT JOIN ind USING (handle, arquivo, pagina)),
lev AS (SELECT *, CASE WHEN origem = 'digital_nativo' THEN 'texto original' WHEN caracteres = 0 THEN 'ruim' WHEN fora IS NULL OR palavras < 20 THEN 'sem medida' WHEN fora <= 0.03 THEN 'bom' WHEN fora <= 0.1 THEN 'regular' ELSE 'ruim' END AS nivel FROM page)"""


def _page_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    origin = F.when(F.col("doc_id") % 4 == 0, "digital_nativo").when(F.col("doc_id") % 4 == 2, "ocr_anterior").otherwise("ocr")
    return d.select(F.col("source").alias("handle"), F.concat("source", F.lit(".pdf")).alias("arquivo"), F.col("doc_id").alias("pagina"), fn.tool_language("lang").alias("idioma"), origin.alias("origem"), F.col("text").alias("texto"))


def _pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each document as a page, its words, and a dictionary: the words of three pages at least."""
    ready = Prepared.of(spark, sf_dir)
    return _page_table(spark, sf_dir), ready.words, ready.dictionary


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = quality.indicators(*(_pages(spark, sf_dir)[k] for k in (0, 2, 1)))
    none = F.lit(None).cast("double")
    level = quality.level(F.col("origem"), F.col("caracteres"), F.col("palavras"), F.col("fora_do_dicionario"), none)
    return i.withColumn("fracao_hesitante", none).withColumn("nivel", level)


@query(f"{QUALITY} SELECT handle, pagina, caracteres, palavras, round(fora, 6) AS fora, nomes::BIGINT AS nomes, nivel FROM lev")
def o12_o18_page_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir).select("handle", "pagina", "caracteres", "palavras", F.round("fora_do_dicionario", 6).alias("fora"), F.col("possiveis_nomes").alias("nomes"), "nivel")


@query(f"{QUALITY}, cnt AS (SELECT handle, arquivo, pagina, palavra, count(*) AS c, min(pos) AS p FROM k WHERE mi AND des GROUP BY ALL), sus AS (SELECT *, row_number() OVER (PARTITION BY handle, arquivo, pagina ORDER BY c DESC, p) AS k FROM cnt) SELECT pagina, string_agg(palavra, ' ' ORDER BY k) AS suspeitas FROM sus WHERE k <= 10 GROUP BY handle, arquivo, pagina")
def o15_suspect_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _levels(spark, sf_dir).filter(F.size("suspeitas") > 0)
    return i.select("pagina", F.array_join("suspeitas", " ").alias("suspeitas"))


@query(f"{QUALITY}, md AS (SELECT *, nivel IN ('bom', 'regular', 'ruim') AND caracteres > 0 AS r FROM lev), g AS (SELECT handle, count(*) AS paginas, count(*) FILTER (origem = 'ocr') AS paginas_ocr, count(*) FILTER (nivel = 'ruim' AND caracteres = 0) AS paginas_vazias, sum(fora * palavras) FILTER (origem <> 'digital_nativo' AND fora IS NOT NULL AND palavras > 0) / nullif(sum(palavras) FILTER (origem <> 'digital_nativo' AND fora IS NOT NULL AND palavras > 0), 0) AS f, count(*) FILTER (nivel = 'texto original') AS nat, count(*) FILTER (r) AS med, count(*) FILTER (nivel = 'ruim') AS ruins, count(*) FILTER (nivel = 'regular') AS regs, count(*) FILTER (nivel = 'bom') AS bons, sum(palavras) FILTER (r) AS w, sum(fora * palavras) FILTER (r AND palavras > 0) / nullif(sum(palavras) FILTER (r AND fora IS NOT NULL AND palavras > 0), 0) AS s FROM md GROUP BY handle) SELECT handle, paginas, paginas_ocr, paginas_vazias, round(f, 6) AS fora, CASE WHEN ruins > 0 THEN 'ruim' WHEN regs > 0 THEN 'regular' WHEN bons > 0 THEN 'bom' END AS pior_pagina, CASE WHEN nat = paginas THEN 'texto original' WHEN med = 0 THEN CASE WHEN ruins > 0 THEN 'ruim' ELSE 'sem medida' END WHEN s IS NULL OR w < 20 THEN 'sem medida' WHEN s <= 0.03 THEN 'bom' WHEN s <= 0.1 THEN 'regular' ELSE 'ruim' END AS nivel FROM g")
def o19_o21_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality.documents(_levels(spark, sf_dir))
    return d.select("handle", "paginas", "paginas_ocr", "paginas_vazias", F.round("fora_do_dicionario", 6).alias("fora"), "pior_pagina", "nivel")


@query(f"{QUALITY}, lw AS (SELECT handle, pagina, palavra, count(*) AS n FROM w WHERE mi GROUP BY ALL), tot AS (SELECT handle, pagina, sum(n) AS t FROM lw GROUP BY ALL), hit AS (SELECT lw.handle, lw.pagina, dic.idioma AS c, sum(n) AS ok FROM lw JOIN dic USING (palavra) GROUP BY ALL), fit AS (SELECT handle, pagina, c, o, 1 - coalesce(ok, 0) / t AS f FROM tot CROSS JOIN (VALUES ('eng', 2), ('spa', 3), ('fra', 4)) l(c, o) LEFT JOIN hit USING (handle, pagina, c)), best AS (SELECT handle, pagina, first(c ORDER BY f, o) AS c FROM fit WHERE f < 0.5 GROUP BY ALL) SELECT pagina, coalesce(c, '') AS idioma_detectado FROM pg LEFT JOIN best USING (handle, pagina)")
def o16_o17_detected_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.detect_language(*_pages(spark, sf_dir)).select("pagina", "idioma_detectado")


FITS = f"{QUALITY}, lw AS (SELECT handle, pagina, palavra, count(*) AS n FROM w WHERE mi GROUP BY ALL), tot AS (SELECT handle, pagina, sum(n) AS t FROM lw GROUP BY ALL), hit AS (SELECT lw.handle, lw.pagina, dic.idioma AS c, sum(n) AS ok FROM lw JOIN dic USING (palavra) GROUP BY ALL), fit AS (SELECT handle, pagina, c, o, 1 - coalesce(ok, 0) / t AS f FROM tot CROSS JOIN (VALUES ('eng', 2), ('spa', 3), ('fra', 4)) l(c, o) LEFT JOIN hit USING (handle, pagina, c))"


MISNAMED = "CASE WHEN pagina % 10 = 0 THEN 'eng' ELSE idioma END"


@query(f"{FITS}, kx AS (SELECT x.handle, x.pagina, i2, mi, CASE WHEN i2 <> 'deu' THEN dic.palavra IS NULL END AS des FROM (SELECT *, {MISNAMED} AS i2 FROM w) x LEFT JOIN dic ON dic.idioma = i2 AND dic.palavra = x.palavra), ix AS (SELECT handle, pagina, any_value(i2) AS i2, avg(des::INT) FILTER (mi) AS fora FROM kx GROUP BY ALL) SELECT pagina, first(c ORDER BY f, o) AS idioma_suspeito FROM fit JOIN ix USING (handle, pagina) WHERE fora > 0.25 AND c <> i2 AND f < fora / 2 GROUP BY handle, pagina")
def o16_better_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Each tenth page is catalogued under a language that is mostly not its own.
    p, words, dictionary = _pages(spark, sf_dir)
    misnamed = F.when(F.col("pagina") % 10 == 0, "eng").otherwise(F.col("idioma"))
    measured = quality.indicators(p.withColumn("idioma", misnamed), dictionary, words.withColumn("idioma", misnamed))
    return quality.better_language(measured, quality.language_fit(words, dictionary)).select("pagina", "idioma_suspeito")


@query(f"{QUALITY}, sug AS (SELECT DISTINCT strip_accents(palavra) AS palavra FROM dic WHERE length(palavra) >= 4 AND strip_accents(palavra) <> palavra) SELECT pagina, count(*) AS acentos_perdidos FROM k JOIN sug USING (palavra) WHERE mi AND des GROUP BY handle, arquivo, pagina")
def o14_lost_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, words, dictionary = _pages(spark, sf_dir)
    sug = dictionary.select(fn.strip_accents("palavra").alias("palavra"), F.col("palavra").alias("sugestao"), F.lit(0).alias("ordem")).distinct()
    return quality.lost_accents(words, dictionary, sug).select("pagina", "acentos_perdidos")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").filter("text is not null")
    ref = F.regexp_replace("text", "[^ -~\n]", "?")
    got = F.regexp_replace(F.regexp_replace(ref, "th", "ht"), r" an", ", an")
    return c.select(F.concat_ws("/", "conv_id", "turn").alias("pagina"), F.when(F.col("turn") % 2 == 0, "a").otherwise("b").alias("motor"), ref.alias("referencia"), got.alias("candidato"))


PAIR = f"SELECT conv_id || '/' || turn AS pagina, CASE WHEN turn % 2 = 0 THEN 'a' ELSE 'b' END AS motor, {ONE_LINE.format('ref')} AS r, {ONE_LINE.format('got')} AS g FROM (SELECT conv_id, turn, ref, replace(replace(ref, 'th', 'ht'), ' an', ', an') AS got FROM (SELECT conv_id, turn, regexp_replace(text, '[^ -~\\n]', '?', 'g') AS ref FROM conversations WHERE text IS NOT NULL))"
BAG = "list_sum(list_transform(list_distinct(list_concat(rw, gw)), lambda w: greatest(0, len(list_filter({0}, lambda x: x = w)) - len(list_filter({1}, lambda y: y = w)))))"


@query(f"SELECT pagina, motor, round(CASE WHEN length(r) > 0 THEN levenshtein(r, g) / length(r) WHEN length(g) > 0 THEN 1 ELSE 0 END, 6) AS cer, round(CASE WHEN len(rw) > 0 THEN greatest(coalesce({BAG.format('rw', 'gw')}, 0), coalesce({BAG.format('gw', 'rw')}, 0)) / len(rw) WHEN len(gw) > 0 THEN 1 ELSE 0 END, 6) AS wer_sem_ordem FROM (SELECT *, list_filter(string_split(r, ' '), lambda w: w <> '') AS rw, list_filter(string_split(g, ' '), lambda w: w <> '') AS gw FROM ({PAIR}))")
def o24_o26_character_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.error_rates(_pairs(spark, sf_dir)).select("pagina", "motor", F.round("cer", 6).alias("cer"), F.round("wer_sem_ordem", 6).alias("wer_sem_ordem"))


@query()
def o27_o28_engines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.mean_by_engine(quality.error_rates(_pairs(spark, sf_dir)))


RATED = f"SELECT motor, CASE WHEN length(r) > 0 THEN levenshtein(r, g) / length(r) WHEN length(g) > 0 THEN 1 ELSE 0 END AS cer, CASE WHEN len(rw) > 0 THEN greatest(coalesce({BAG.format('rw', 'gw')}, 0), coalesce({BAG.format('gw', 'rw')}, 0)) / len(rw) WHEN len(gw) > 0 THEN 1 ELSE 0 END AS bag FROM (SELECT *, list_filter(string_split(r, ' '), lambda w: w <> '') AS rw, list_filter(string_split(g, ' '), lambda w: w <> '') AS gw FROM ({PAIR}))"


@query(f"SELECT motor, count(*) AS paginas, round(avg(cer), 6) AS cer, round(avg(bag), 6) AS wer_sem_ordem FROM ({RATED}) GROUP BY motor")
def o28_engine_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = quality.mean_by_engine(quality.error_rates(_pairs(spark, sf_dir)))
    return m.select("motor", "paginas", F.round("cer", 6).alias("cer"), F.round("wer_sem_ordem", 6).alias("wer_sem_ordem"))


@query("SELECT r.pagina, e.motor, c.pagina IS NULL AS falta FROM (SELECT conv_id AS pagina FROM conversations WHERE turn = 0) r CROSS JOIN (VALUES ('a'), ('b'), ('c')) e(motor) LEFT JOIN (SELECT conv_id AS pagina, CASE turn % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS motor FROM conversations WHERE turn BETWEEN 1 AND 3) c USING (pagina, motor)")
def j11_o27_candidate_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    references = c.filter("turn = 0").select(F.col("conv_id").alias("pagina"), F.col("text").alias("referencia"))
    engine = F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("turn") % 3 + 1).cast("int"))
    candidates = c.filter("turn between 1 and 3").select(F.col("conv_id").alias("pagina"), engine.alias("motor"), F.col("text").alias("candidato"))
    engines = spark.createDataFrame([("a",), ("b",), ("c",)], "motor string")
    return quality.candidate_grid(references, engines, candidates).select("pagina", "motor", "falta")


# ── positioned pages and line-wrapped text ──


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a page of 1000 x 2000: a region for every four lines, wrapped text down the page, holes in the margin."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("l"))
    point = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))

    def line(t: Column, i: Column) -> Column:
        left = F.when(i % 7 == 6, 20).otherwise(200)
        y = F.pmod(i * 60, F.lit(1900))
        text = F.when(i % 7 == 6, F.lit("3 o")).otherwise(t)
        empty = F.array().cast(regions.POINTS)
        words = F.transform(F.split(text, " "), lambda w: F.struct(w.alias("texto"), empty.alias("contorno"), (F.pmod(F.length(w) * 37, F.lit(100)) / 100).cast("double").alias("confianca")))
        return F.struct(F.concat(F.lit("l"), i.cast("string")).alias("id"), text.alias("texto"), F.array(point(left, y), point(left + F.when(i % 7 == 6, 30).otherwise(600), y + 40)).alias("contorno"), empty.alias("linha_de_base"), words.alias("palavras"), F.lit(None).cast("double").alias("confianca"))

    rows = d.withColumn("l", F.transform("l", line))
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / 4).cast("int")), lambda g: F.struct(F.concat(F.lit("r"), g.cast("string")).alias("id"), F.lit("texto").alias("tipo"), F.array().cast(regions.POINTS).alias("contorno"), F.slice("l", g * 4 + 1, 4).alias("linhas")))
    return rows.select("doc_id", F.lit(1000).alias("largura"), F.lit(2000).alias("altura"), F.lit("").alias("imagem"), groups.alias("regioes"))


USEFUL = r"length(regexp_replace({}, '[^\p{{L}}\p{{N}}]', '', 'g'))"
# Groups of four lines; the margin's lines are '3 o'; f: lines that aren't blank.
REGIONS = rf"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
g AS (SELECT doc_id, g, list_transform(range(g * 4, least(g * 4 + 4, len(l))), lambda i: {{{{'m': i % 7 = 6, 't': CASE WHEN i % 7 = 6 THEN '3 o' ELSE l[i + 1] END}}}}) AS x FROM (SELECT *, unnest(range(0, (len(l) + 3) // 4)) AS g FROM l)),
f AS (SELECT *, list_filter(x, lambda y: {STRIP.format('y.t')} <> '') AS f FROM g),
r AS (SELECT *, CASE WHEN len(f) = 1 AND regexp_matches(f[1].t, '^[^\p{{{{L}}}}\p{{{{N}}}}_]*\p{{{{Nd}}}}{{{{1,4}}}}[^\p{{{{L}}}}\p{{{{N}}}}_]*$') THEN 'numero_de_pagina' WHEN len(f) >= 3 AND len(list_filter(f, lambda y: {USEFUL.format('y.t')} > 3)) = 0 THEN 'ruido' ELSE 'texto' END AS tipo FROM f)""".replace("{{", "{").replace("}}", "}")


@query(f"{REGIONS}, b AS (SELECT doc_id, g, array_to_string(list_transform(list_filter(f, lambda y: tipo <> 'texto' OR NOT y.m), lambda z: replace(z.t, '¬', '-')), chr(10)) AS t FROM r WHERE tipo <> 'ruido') SELECT l.doc_id, CASE WHEN l.l IS NOT NULL THEN md5(coalesce(string_agg(t, chr(10) || chr(10) ORDER BY g) FILTER (t <> ''), '')) END AS texto FROM l LEFT JOIN b USING (doc_id) GROUP BY l.doc_id, l.l")
def o2_o5_derived_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.mark_noise(_placed(spark, sf_dir)).select("doc_id", F.md5(regions.derived_text("regioes")).alias("texto"))


@query()
def o3_o31_page_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = regions.split_stamps(regions.mark_noise(_placed(spark, sf_dir)), ["Instituto de Pesquisa", "Arquivo Geral"])
    c = regions.confidence("regioes")
    return p.select("doc_id", F.size("regioes").alias("regioes"), regions.has_columns("regioes").alias("colunas"), F.round(c["confianca_media"], 6).alias("confianca"), F.round(c["fracao_hesitante"], 6).alias("hesitante"), c["linhas_hesitantes"].alias("linhas"))


@query(f"{REGIONS}, k AS (SELECT unnest(list_transform(x, lambda y: CASE WHEN tipo = 'texto' AND y.m THEN 'ruido' ELSE tipo END)) AS tipo FROM r) SELECT tipo, count(*) AS linhas FROM k GROUP BY tipo")
def o30_lines_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.lines_by_kind(regions.mark_noise(_placed(spark, sf_dir)))


def _wrapped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages with words broken over lines at the mark ¬ or a hyphen."""
    p, _, dictionary = _pages(spark, sf_dir)
    text = F.regexp_replace(F.regexp_replace("texto", r"(\p{Ll}{3})(\p{Ll}{3}) ", "$1¬\n$2 "), r", (\p{Ll}{4})(\p{Ll}{3})", ", $1-\n$2")
    return p.select(F.col("pagina"), "idioma", text.alias("texto")), dictionary


@query()
def o7_o8_break_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise.decisions(*_wrapped(spark, sf_dir)).groupBy("hifen", "regra").agg(F.count("*").alias("n"))


@query()
def o9_o11_normalised_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = normalise.pages_text(*_wrapped(spark, sf_dir))
    return out.select("pagina", F.md5("texto").alias("texto"), F.aggregate(F.map_values("regras"), F.lit(0), lambda a, b: a + b).alias("aplicadas"))


# ── joins, sources, catalogue ──


@query(r"SELECT doc_id, i::INT AS pagina, md5(regexp_replace(nfc_normalize(ps[i]), '^\s+|\s+$', '', 'g')) AS texto FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT doc_id, string_split_regex(text, '\n\s*\n') AS ps FROM documents))")
def s19_split_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"\n\s*\n", pages.PAGE_BREAK).alias("texto"))
    return pages.split_pages(d).select("doc_id", "pagina", F.md5(pages.page_text("texto")).alias("texto"))


@query(r"SELECT doc_id, md5(array_to_string(list_filter(list_transform(list_filter(string_split_regex(text, '\n\s*\n'), lambda b: regexp_replace(b, '^\s+|\s+$', '', 'g') <> ''), lambda c: replace(array_to_string(list_filter(string_split_regex(c, '\r\n|\r|\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g') <> ''), chr(10)), '¬', '-')), lambda d: d <> ''), chr(10) || chr(10))) AS texto FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]')")
def s17_s18_page_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    # XML has no control characters: texts with some aren't pages.
    d = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull() & ~F.col("text").rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"))
    page = d.select("doc_id", F.lit(0).alias("largura"), F.lit(0).alias("altura"), F.lit("").alias("imagem"), pages.unplaced("text").alias("regioes"))
    return pages.read_page_xml(pages.write_page_xml(page)).select("doc_id", F.md5(regions.derived_text("regioes")).alias("texto"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'revisada' WHEN doc_id % 2 = 0 THEN 'ocr' END AS versao FROM documents")
def j15_s20_effective_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id")
    reviewed, read = d.filter("doc_id % 3 = 0").withColumn("versao", F.lit("revisada")), d.filter("doc_id % 2 = 0").withColumn("versao", F.lit("ocr"))
    return pages.effective(d, reviewed, read, ["doc_id"], "versao")


@query("SELECT page_id AS id, 'fica' AS situacao FROM pages WHERE page_id IN (SELECT doc_id * 2 FROM documents) UNION ALL SELECT DISTINCT doc_id * 2, 'ausente' FROM documents WHERE doc_id * 2 NOT IN (SELECT page_id FROM pages)")
def j3_p8_restricted(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "documents").select((F.col("doc_id") * 2).alias("id"))
    kept, absent = stages.restricted(table(spark, sf_dir, "pages").select(F.col("page_id").alias("id")), wanted, "id")
    return kept.withColumn("situacao", F.lit("fica")).unionByName(absent.withColumn("situacao", F.lit("ausente")))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 5 <> 4 THEN 'doc_' || doc_id || '.pdf' END AS arquivo, CASE WHEN doc_id % 5 <> 4 THEN (doc_id % 7)::INT END AS pagina, doc_id % 2 = 1 OR doc_id % 5 = 4 AS falta FROM documents")
def j16_asked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    ending = F.when(i % 5 == 4, F.lit("")).otherwise(F.concat(F.lit("_p"), F.lpad((i % 7).cast("string"), 4, "0")))
    d = table(spark, sf_dir, "documents")
    wanted = d.select("doc_id", F.concat(F.lit("7891_"), i.cast("string"), F.lit("_doc_"), i.cast("string"), ending).alias("identificador"))
    files = d.filter("doc_id % 2 = 0").select(F.concat(F.lit("7891/"), "doc_id").alias("handle"), F.concat(F.lit("doc_"), "doc_id", F.lit(".pdf")).alias("arquivo"), F.lit("").alias("idioma"))
    return wanted.join(pages.asked_pages(wanted, files), "identificador").select("doc_id", "arquivo", "pagina", "falta")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j1_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


@query("SELECT conv_id AS arquivo, (i + CASE WHEN i > 1 THEN 2 ELSE 0 END)::INT AS pagina, TRUE AS ok, FALSE AS aviso FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations) UNION ALL SELECT DISTINCT conv_id, 2, TRUE, TRUE FROM conversations")
def s15_sidecar_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    texts = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]).alias("t"))
    notice = F.array(F.lit("\n[OCR skipped on page(s) 2-3] "))
    sidecar = texts.select(F.col("conv_id").alias("arquivo"), F.array_join(F.concat(F.slice("t", 1, 1), notice, F.slice("t", 2, 1 << 30)), "\f").alias("texto"))
    return archive.sidecar_pages(sidecar).select("arquivo", "pagina", F.col("certo").alias("ok"), F.col("de").isNotNull().alias("aviso"))


@query("SELECT conv_id AS pagina, round(avg(CASE WHEN turn % 3 > 0 THEN turn * 10.0 END), 6) AS confianca FROM conversations GROUP BY conv_id")
def s16_word_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    row = F.concat(F.lit("5\t1\t1\t1\t1\t1\t0\t0\t9\t9\t"), F.when(F.col("turn") % 3 > 0, F.col("turn") * 10).otherwise(-1).cast("string"), F.lit("\tword"))
    tsv = c.groupBy(F.col("conv_id").alias("pagina")).agg(F.concat(F.lit("level\theader\n4\tx\n"), F.array_join(F.collect_list(row), "\n")).alias("tsv"))
    return archive.word_confidence(tsv).select("pagina", F.round("confianca", 6).alias("confianca"))


@query("SELECT arquivo, pagina, round(max(least(0.4 + 0.1 * turn, 2)::DOUBLE), 6) AS cobertura FROM (SELECT conv_id AS arquivo, (turn % 2) AS pagina, turn FROM conversations) GROUP BY ALL")
def s13_image_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("arquivo"), (F.col("turn") % 2).alias("pagina"), "turn")
    images = c.select("arquivo", "pagina", (F.least(F.lit(0.4) + F.lit(0.1) * F.col("turn"), F.lit(2.0)) * 1000).alias("w"), F.lit(1000.0).alias("h"), F.lit(72.0).alias("xppi"), F.lit(72.0).alias("yppi"))
    pages = c.select("arquivo", "pagina").distinct().withColumn("largura", F.lit(1000.0)).withColumn("altura", F.lit(1000.0))
    return archive.coverage(images, pages).select("arquivo", "pagina", F.round("cobertura", 6).alias("cobertura"))


@query(r"SELECT doc_id, CASE WHEN length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) < 200 OR doc_id % 10 = 9 THEN TRUE ELSE FALSE END AS reconhecer, CASE WHEN doc_id % 5 = 0 THEN 'ocr' WHEN length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) < 200 THEN 'sem_texto' WHEN doc_id % 5 = 1 THEN 'ocr_anterior' ELSE 'digital_nativo' END AS origem FROM documents")
def p4_p5_page_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("texto", F.col("text")).withColumn("cobertura", F.when(F.col("doc_id") % 10 == 9, 0.95).otherwise(0.2))
    return archive.needs_recognition(d, 200).select("doc_id", "reconhecer", archive.origin(F.col("doc_id") % 5 == 0, "texto", F.col("doc_id") % 5 == 1, 200).alias("origem"))


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 OR (doc_id % 3 > 0 AND (doc_id % 11) / 10 > (doc_id % 6) / 10) THEN 'anterior' ELSE 'nosso' END AS escolhido FROM documents")
def p6_chosen_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    ours = F.when(i % 7 == 0, F.lit("  ")).otherwise(F.lit("nosso"))
    return table(spark, sf_dir, "documents").select("doc_id", archive.choose_reading(F.lit("anterior"), ours, F.when(i % 3 > 0, (i % 6) / 10), (i % 11) / 10).alias("escolhido"))


@query("SELECT doc_id, CASE greatest(CASE quality WHEN 1 THEN 1 ELSE 3 END, CASE toxic WHEN 1 THEN 3 ELSE 2 END) WHEN 2 THEN 'interno' ELSE 'vedado' END AS restricao FROM documents LEFT JOIN labels USING (doc_id)")
def k4_restrictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    by_quality = F.when(F.col("quality") == 1, "publicavel").when(F.col("quality") == 0, "vedado")
    by_toxicity = F.when(F.coalesce("toxic", F.lit(0)) == 1, "vedado").otherwise("interno")
    return d.select("doc_id", catalogue.most_restrictive(by_quality, by_toxicity).alias("restricao"))


@query(f"{BASE}, {_search(8, name='lx').replace('FROM chunks', 'FROM open')} SELECT consulta_id, posicao, chunk_id, round(score, 6) AS score FROM lx".replace(", tok AS", ", open AS (SELECT * FROM chunks WHERE titulo_pagina IN (SELECT source FROM documents GROUP BY source HAVING min(doc_id) % 2 = 0)), tok AS"))
def k6_allowed_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = passages(spark, sf_dir)
    rule = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("titulo_pagina")).agg(F.when(F.min("doc_id") % 2 == 0, "publicavel").alias("restricao_uso"))
    open_ = catalogue.allowed(p.join(rule, "titulo_pagina"))
    return _out(lexical.search(lexical.build(cut(open_)), questions(spark, sf_dir), 8))


@query(r"SELECT page_id, 'hdl-' || (page_id % 900 + 100) || '-' || page_id AS handle FROM pages")
def k2_handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("https://archive.example/handle/"), (F.col("page_id") % 900 + 100).cast("string"), F.lit("/"), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", catalogue.handle_id(url).alias("handle"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1950 + doc_id % 60 WHEN doc_id % 3 = 1 THEN 2001 END::INT AS ano, CASE doc_id % 3 WHEN 0 THEN 'exata' WHEN 1 THEN 'aproximada' ELSE 'ausente' END AS precisao FROM documents")
def k7_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    issued, got = F.when(i % 3 == 0, F.concat(F.lit("c. "), (1950 + i % 60).cast("string"), F.lit("-05"))), F.when(i % 3 == 1, F.lit("2001-02-03T00:00:00Z"))
    y = catalogue.year(issued, got)
    return table(spark, sf_dir, "documents").select("doc_id", y["ano"].alias("ano"), y["precisao"].alias("precisao"))


@query("SELECT handle, campo, first(valor ORDER BY r) AS valor, count(DISTINCT valor) > 1 AS conflito FROM (SELECT source AS handle, 'titulo' AS campo, lang || doc_id AS valor, (CASE lang WHEN 'es' THEN 5 WHEN 'en' THEN 6 WHEN 'fr' THEN 7 ELSE 99 END, lang || doc_id) AS r FROM documents) GROUP BY ALL")
def k1_preferred_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("handle"), F.lit("titulo").alias("campo"), F.col("lang").alias("idioma"), F.concat("lang", "doc_id").alias("valor"))
    return catalogue.first_by_language(d).select("handle", "campo", "valor", "conflito")


@query("SELECT source AS handle, 'campo ausente: quality' AS motivo FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL UNION ALL SELECT source, 'handle repetido' FROM documents GROUP BY source HAVING count(*) > 1")
def k5_blocking_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select(F.col("source").alias("handle"), "quality")
    return catalogue.blocking_problems(d, ("quality",))
