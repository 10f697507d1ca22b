"""Models behind interfaces: embedding, generation, spelling, recognition. Each is a plain function over a batch that runs on the executors."""

from __future__ import annotations

import subprocess
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, StringType

# Recognition languages and the dictionaries of the spelling tool.
DICTIONARIES = {"por": "pt_BR", "eng": "en_US", "spa": "es_ES", "fra": "fr_FR", "deu": "de_DE", "ita": "it_IT"}
TRANSIENT = (429, 500, 502, 503, 504)


class ProviderError(RuntimeError):
    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


def retried(call: Callable, attempts: int = 3, backoff: float = 0.5, wait: Callable[[float], None] = time.sleep) -> Callable:
    """`call` again after a transient failure (no status, or one of TRANSIENT), waiting twice as long each time."""

    def run(*args, **kwargs):
        for i in range(attempts):
            try:
                return call(*args, **kwargs)
            except ProviderError as e:
                if i + 1 == attempts or (e.status is not None and e.status not in TRANSIENT):
                    raise
                wait(backoff * 2**i)

    return run


def embedder(embed: Callable[[list[str]], list[list[float]]], dim: int, size: int = 64):
    """A vectorised function over texts. A batch that comes back with another number of vectors, or of another dimension, is an error: it would index every text under its neighbour's vector."""

    @pandas_udf(ArrayType(DoubleType()))
    def run(texts: pd.Series) -> pd.Series:
        out: list[list[float]] = []
        for at in range(0, len(texts), size):
            batch = [t or "" for t in texts[at : at + size]]
            got = embed(batch)
            if len(got) != len(batch) or any(len(v) != dim for v in got):
                raise ProviderError(f"{len(got)} vectors came back for {len(batch)} texts, or not all of {dim} dimensions")
            out += [[float(x) for x in v] for v in got]
        return pd.Series(out)

    return run


def generator(generate: Callable[[str], Iterator[str]]):
    """A vectorised function over prompts: the pieces of each answer joined; null for a null prompt or where the provider failed."""

    @pandas_udf(StringType())
    def run(prompts: pd.Series) -> pd.Series:
        def one(p: str | None) -> str | None:
            try:
                return None if p is None else "".join(generate(p))
            except ProviderError:
                return None

        return prompts.map(one)

    return run


def unknown_words(words: DataFrame, check: Callable[[list[str], str], set[str] | None]) -> DataFrame:
    """(idioma, palavra) -> the dictionary's side of it: (idioma, palavra, conhecida), null where the language has no dictionary. Each distinct word is asked once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for language, part in f.groupby("idioma"):
                missing = check(sorted(part["palavra"]), language)
                yield part.assign(conhecida=None if missing is None else [w not in missing for w in part["palavra"]])

    return words.select("idioma", "palavra").distinct().mapInPandas(run, "idioma string, palavra string, conhecida boolean")


def suggestions(words: DataFrame, suggest: Callable[[list[str], str], dict[str, list[str]] | None]) -> DataFrame:
    """(idioma, palavra) -> (idioma, palavra, sugestao, ordem)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(language, w, s, i) for language, part in f.groupby("idioma") for w, listed in (suggest(sorted(part["palavra"]), language) or {}).items() for i, s in enumerate(listed)]
            yield pd.DataFrame(rows, columns=["idioma", "palavra", "sugestao", "ordem"])

    return words.select("idioma", "palavra").distinct().mapInPandas(run, "idioma string, palavra string, sugestao string, ordem int")


def _hunspell(mode: str, words: list[str], language: str) -> str | None:
    if language not in DICTIONARIES:
        return None
    try:
        done = subprocess.run(["hunspell", mode, "-d", DICTIONARIES[language]], input="\n".join(words), capture_output=True, text=True, encoding="utf-8", check=False)
    except FileNotFoundError:
        return None
    # The tool ends with 0 without a dictionary too, and says so on the error output only.
    return None if done.returncode or "Can't open" in done.stderr else done.stdout


def hunspell_unknown(words: list[str], language: str) -> set[str] | None:
    out = _hunspell("-l", words, language)
    return None if out is None else {x.strip() for x in out.splitlines() if x.strip()}


def hunspell_suggestions(words: list[str], language: str) -> dict[str, list[str]] | None:
    out = _hunspell("-a", words, language) if words else ""
    if out is None or language not in DICTIONARIES:
        return None
    listed = (x[2:].partition(": ") for x in out.splitlines() if x.startswith("& "))
    return {head.split(" ")[0]: [s.strip() for s in tail.split(",") if s.strip()] for head, _, tail in listed}


def text_layers(files: DataFrame, command: tuple[str, ...] = ("pdftotext", "-layout", "-", "-")) -> DataFrame:
    """binaryFile rows -> (path, pagina, texto): a file's text layer by page. `paginas` of the file, where known, must be the number of pieces."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples():
                done = subprocess.run(command, input=r.content, capture_output=True, check=False)
                if done.returncode:
                    raise ProviderError(f"{r.path}: {done.stderr.decode(errors='replace')[:300]}")
                pages = done.stdout.decode(errors="replace").removesuffix("\f").split("\f")
                if r.paginas is not None and r.paginas == r.paginas and int(r.paginas) != len(pages):
                    raise ProviderError(f"{r.path}: {len(pages)} pieces for {int(r.paginas)} pages")
                rows += [(r.path, i, t) for i, t in enumerate(pages, 1)]
            yield pd.DataFrame(rows, columns=["path", "pagina", "texto"])

    known = files if "paginas" in files.columns else files.withColumn("paginas", F.lit(None).cast("int"))
    return known.select("path", "content", "paginas").mapInPandas(run, "path string, pagina int, texto string")


def recognise(pages: DataFrame, engine: Callable[[bytes, int, str], str], reserve: Callable[[bytes, int, str], str] | None = None, least: int = 50) -> DataFrame:
    """(path, content, pagina, idioma) -> (path, pagina, texto, motor). Pages that the engine reads under `least` letters and digits go to the reserve, whose
    reading stays if it has more; a page that fails gives null and isn't the others' failure."""

    def useful(t: str | None) -> int:
        return sum(c.isalnum() for c in t or "")

    def read(f, *args) -> str | None:
        try:
            return f(*args)
        except ProviderError:
            return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples():
                args = (bytes(r.content), int(r.pagina), r.idioma)
                text, name = read(engine, *args), "principal"
                if reserve is not None and useful(text) < least:
                    second = read(reserve, *args)
                    if useful(second) > useful(text):
                        text, name = second, "reserva"
                rows.append((r.path, int(r.pagina), text, name if text is not None else None))
            yield pd.DataFrame(rows, columns=["path", "pagina", "texto", "motor"])

    return pages.select("path", "content", "pagina", "idioma").mapInPandas(run, "path string, pagina int, texto string, motor string")
