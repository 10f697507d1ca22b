"""Page and document quality by dictionary, and error rates against references."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from unicodedata import normalize

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as fn

GOOD, REGULAR, LEAST_WORDS, HESITANT, LANGUAGE, SUSPECTS = 0.03, 0.10, 20, 0.10, 0.25, 10
LANGUAGES = ("por", "eng", "spa", "fra")
LEVELS = ("bom", "regular", "ruim")
PAGE = ["handle", "arquivo", "pagina"]


def page_words(pages: DataFrame) -> DataFrame:
    """One row a distinct word of a page: page keys, idioma, palavra, n, primeira (its first place), minuscula, maiuscula."""
    keys = [*PAGE, "idioma"]
    shape = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row: list[int] = []
            names: list[str] = []
            times: list[int] = []
            first: list[int] = []
            for i, text in enumerate(b.column(len(keys)).to_pylist()):
                found = fn.word_list(text or "")
                place = dict(zip(reversed(found), range(len(found) - 1, -1, -1), strict=True))
                counts = Counter(found)
                names += counts.keys()
                times += counts.values()
                first += [place[w] for w in counts]
                row += [i] * len(counts)
            take = pa.array(row, pa.int64())
            case = [pa.array([f(w[0]) for w in names], pa.bool_()) for f in (str.islower, str.isupper)]
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in range(len(keys))), pa.array(names, pa.string()), pa.array(times, pa.int64()), pa.array(first, pa.int32()), *case], [*keys, "palavra", "n", "primeira", "minuscula", "maiuscula"])

    return pages.select(*keys, "texto").mapInArrow(run, f"{shape}, palavra string, n long, primeira int, minuscula boolean, maiuscula boolean")


def known(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Adds `desconhecida`: null where the language has no dictionary."""
    d = dictionary.select("idioma", "palavra").distinct().withColumn("_in", F.lit(True))
    langs = dictionary.select("idioma").distinct().withColumn("_lang", F.lit(True))
    j = words.join(d, ["idioma", "palavra"], "left").join(F.broadcast(langs), "idioma", "left")  # a row a language
    return j.withColumn("desconhecida", F.when(F.col("_lang"), F.col("_in").isNull())).drop("_in", "_lang")


def indicators(pages: DataFrame, dictionary: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """Characters, words, share out of the dictionary among lower-case words, possible names, suspects; null: not measured."""
    w = known(page_words(pages) if words is None else words, dictionary)
    low, wrong, n = F.col("minuscula"), F.col("desconhecida"), F.col("n")
    suspects = F.array_sort(F.collect_list(F.when(low & wrong, F.struct((-n).alias("n"), "primeira", "palavra"))))
    agg = w.groupBy(*PAGE).agg(
        F.sum("n").alias("palavras"),
        (F.sum(F.when(low & wrong, n).when(low & wrong.isNotNull(), 0)) / F.sum(F.when(low & wrong.isNotNull(), n))).alias("fora_do_dicionario"),
        F.sum(F.when(F.col("maiuscula") & wrong, n).when(wrong.isNotNull(), 0)).alias("possiveis_nomes"),
        F.transform(F.slice(suspects, 1, SUSPECTS), lambda x: x["palavra"]).alias("suspeitas"),
    )
    base = pages.select(*PAGE, "idioma", "origem", fn.useful_characters("texto").alias("caracteres"))
    out = base.join(agg, PAGE, "left")
    return out.select(*PAGE, "idioma", "origem", "caracteres", F.coalesce("palavras", F.lit(0)).alias("palavras"), "fora_do_dicionario", "possiveis_nomes", F.coalesce("suspeitas", F.array().cast("array<string>")).alias("suspeitas"))


def lost_accents(words: DataFrame, dictionary: DataFrame, suggestions: DataFrame) -> DataFrame:
    """How many unknown lower-case words differ from one of their first three suggestions by accents only."""
    near = suggestions.filter(F.col("ordem") < 3).filter(fn.only_accent_missing("palavra", "sugestao")).select("palavra").distinct()
    w = known(words, dictionary).filter("minuscula and desconhecida")
    return w.join(near, "palavra", "left_semi").groupBy(*PAGE).agg(F.sum("n").alias("acentos_perdidos"))


def language_fit(words: DataFrame, dictionary: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """(page, candidata, fracao): the share of lower-case words outside each candidate language's dictionary."""
    known_langs = dictionary.select("idioma").distinct().filter(F.col("idioma").isin(*languages)).withColumnRenamed("idioma", "candidata")
    w = words.filter("minuscula")
    total = w.groupBy(*PAGE).agg(F.sum("n").alias("total"))
    hit = w.select(*PAGE, "palavra", "n").join(dictionary.select(F.col("idioma").alias("candidata"), "palavra").distinct(), "palavra").groupBy(*PAGE, "candidata").agg(F.sum("n").alias("ok"))
    # Every measured language of every page, from the pages' side: a fixed handful of languages.
    grid = total.withColumn("candidata", F.explode(F.array(*map(F.lit, languages)))).join(F.broadcast(known_langs), "candidata", "left_semi")
    return grid.join(hit, [*PAGE, "candidata"], "left").select(*PAGE, "candidata", (1 - F.coalesce("ok", F.lit(0)) / F.col("total")).alias("fracao"))


def _best(fit: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """The candidate of each page that misses least; the order of `languages` breaks ties."""
    rank = F.array_position(F.array(*map(F.lit, languages)), F.col("candidata"))
    return fit.groupBy(*PAGE).agg(F.min(F.struct("fracao", rank.alias("r"), "candidata")).alias("m")).select(*PAGE, F.col("m.candidata").alias("candidata"))


def detect_language(pages: DataFrame, words: DataFrame, dictionary: DataFrame, languages: tuple[str, ...] = LANGUAGES, below: float = 0.5) -> DataFrame:
    """The language that misses least, if under `below`; '' otherwise."""
    best = _best(language_fit(words, dictionary, languages).filter(F.col("fracao") < below), languages)
    return pages.select(*PAGE).join(best, PAGE, "left").select(*PAGE, F.coalesce("candidata", F.lit("")).alias("idioma_detectado"))


def better_language(measured: DataFrame, fit: DataFrame, languages: tuple[str, ...] = LANGUAGES, over: float = LANGUAGE) -> DataFrame:
    """(page, idioma_suspeito) of pages over `over` whose words miss another language's dictionary less than half as often: the catalogue may be wrong."""
    own = measured.filter(F.col("fora_do_dicionario") > over).select(*PAGE, "idioma", "fora_do_dicionario")
    others = fit.join(own, PAGE).filter((F.col("candidata") != F.col("idioma")) & (F.col("fracao") < F.col("fora_do_dicionario") / 2))
    return _best(others, languages).withColumnRenamed("candidata", "idioma_suspeito")


def level(origin: Column, characters: Column, words: Column, share: Column, hesitant: Column) -> Column:
    step = F.when(share <= GOOD, 0).when(share <= REGULAR, 1).otherwise(2) + F.when(F.coalesce(hesitant > HESITANT, F.lit(False)), 1).otherwise(0)
    graded = F.element_at(F.array(*map(F.lit, LEVELS)), F.least(step, F.lit(2)) + 1)
    return (
        F.when(origin == "digital_nativo", F.lit("texto original"))
        .when((characters == 0) | (origin == "sem_texto"), F.lit("ruim"))
        .when(share.isNull() | (words < LEAST_WORDS), F.lit("sem medida"))
        .otherwise(graded)
    )


def weighted(value: Column, weight: Column) -> Column:
    ok = value.isNotNull() & (weight > 0)
    return F.sum(F.when(ok, value * weight)) / F.nullif(F.sum(F.when(ok, weight)), F.lit(0))


def documents(pages: DataFrame) -> DataFrame:
    """Pages with nivel (and fracao_hesitante) -> counts by origin and level, weighted share, worst page, level."""
    o, n = F.col("origem"), F.col("nivel")
    rated = n.isin(*LEVELS) & (F.col("caracteres") > 0)
    only = lambda c: F.when(rated, F.col(c))
    g = pages.groupBy("handle", "arquivo").agg(
        F.count("*").alias("paginas"),
        F.count_if(o == "ocr").alias("paginas_ocr"),
        F.count_if(o == "ocr_anterior").alias("paginas_ocr_anterior"),
        F.count_if(o == "digital_nativo").alias("paginas_originais"),
        F.count_if((n == "ruim") & ((F.col("caracteres") == 0) | (o == "sem_texto"))).alias("paginas_vazias"),
        F.count_if(n == "texto original").alias("_native"),
        F.count_if(n == "ruim").alias("_bad"),
        F.count_if(n == "regular").alias("_fair"),
        F.count_if(n == "bom").alias("_good"),
        weighted(F.when(o != "digital_nativo", F.col("fora_do_dicionario")), F.col("palavras")).alias("fora_do_dicionario"),
        F.count_if(rated).alias("_rated"),
        F.sum(only("palavras")).alias("_w"),
        F.sum(only("caracteres")).alias("_c"),
        weighted(only("fora_do_dicionario"), F.col("palavras")).alias("_share"),
        weighted(only("fracao_hesitante"), F.col("palavras")).alias("_hes"),
    )
    worst = F.when(F.col("_bad") > 0, "ruim").when(F.col("_fair") > 0, "regular").when(F.col("_good") > 0, "bom")
    doc = (
        F.when(F.col("_native") == F.col("paginas"), F.lit("texto original"))
        .when(F.col("_rated") == 0, F.when(F.col("_bad") > 0, F.lit("ruim")).otherwise(F.lit("sem medida")))
        .otherwise(level(F.lit("ocr"), F.col("_c"), F.col("_w"), F.col("_share"), F.col("_hes")))
    )
    return g.select("handle", "arquivo", "paginas", "paginas_ocr", "paginas_ocr_anterior", "paginas_originais", "paginas_vazias", "fora_do_dicionario", worst.alias("pior_pagina"), doc.alias("nivel"))


def report(docs: DataFrame) -> DataFrame:
    """Counts of documents and pages a level, worst first."""
    order = F.array_position(F.array(*[F.lit(x) for x in ("ruim", "regular", "bom", "sem medida", "texto original")]), F.col("nivel"))
    return docs.groupBy("nivel").agg(F.count("*").alias("documentos"), F.sum("paginas").alias("paginas"), F.sum("paginas_vazias").alias("vazias")).orderBy(order)


# ── error rates ──

PUNCTUATION = re.compile(r"([^\w\s])")


def canonical(text: str) -> str:
    """Composed form, any whitespace to single spaces."""
    return " ".join(normalize("NFC", text).split())


def edit_distance(a: Sequence, b: Sequence) -> int:
    """Insertions, deletions and substitutions from a to b, of characters or words alike: a whole column of the table is one
    integer whose bits are the steps up and down it, so any length and any number of different items is exact."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    every, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    wanted, at = set(b), {}
    for i, x in enumerate(a):
        if x in wanted:
            at[x] = at.get(x, 0) | 1 << i
    up, down, distance = every, 0, len(a)
    for x in b:
        same = at.get(x, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        plus, minus = down | ~(diagonal | up) & every, up & diagonal
        distance += (plus & top > 0) - (minus & top > 0)
        plus, minus = (plus << 1 | 1) & every, minus << 1 & every
        up, down = minus | ~(diagonal | plus) & every, plus & diagonal
    return distance


def rate(errors: int, size: int) -> float:
    return errors / size if size else float(errors > 0)


def rates(reference: str, candidate: str) -> tuple[float, float, float, float]:
    """By characters, by words, by words with punctuation set apart, and by words whatever their order."""
    r, c = canonical(reference), canonical(candidate)
    words = (r.split(), c.split())
    apart = tuple(PUNCTUATION.sub(r" \1 ", t).split() for t in (r, c))
    bags = tuple(map(Counter, words))
    unordered = max((bags[0] - bags[1]).total(), (bags[1] - bags[0]).total())
    return rate(edit_distance(r, c), len(r)), rate(edit_distance(*words), len(words[0])), rate(edit_distance(*apart), len(apart[0])), rate(unordered, len(words[0]))


RATES = ("cer", "wer", "wer_pontuacao_separada", "wer_sem_ordem")


def error_rates(pairs: DataFrame) -> DataFrame:
    """(pagina, motor, referencia, candidato) -> the four rates; null texts are empty."""
    shape = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in ("pagina", "motor"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [rates(r or "", c or "") for r, c in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([f[i] for f in found], pa.float64()) for i in range(4))], ["pagina", "motor", *RATES])

    return pairs.select("pagina", "motor", "referencia", "candidato").mapInArrow(run, f"{shape}, {', '.join(f'{c} double' for c in RATES)}")


def candidate_grid(references: DataFrame, engines: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every reference page with every engine (a handful, checked): (pagina, motor, referencia, candidato, falta). `falta`: the engine has no such page."""
    names = [r["motor"] for r in engines.select("motor").distinct().orderBy("motor").limit(1001).collect()]
    if len(names) > 1000:
        raise ValueError("more than 1000 engines")
    grid = references.withColumn("motor", F.explode(F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")))
    out = grid.join(candidates.withColumn("_there", F.lit(True)), ["pagina", "motor"], "left")
    return out.select("pagina", "motor", "referencia", "candidato", F.col("_there").isNull().alias("falta"))


def mean_by_engine(rates: DataFrame) -> DataFrame:
    return rates.groupBy("motor").agg(F.count("*").alias("paginas"), *[F.avg(c).alias(c) for c in RATES])
