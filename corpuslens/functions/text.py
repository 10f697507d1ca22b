"""Column expressions over text. All run inside the JVM but for the three that need Unicode's normal forms, which are vectorised."""

from __future__ import annotations

import re
from collections.abc import Callable
from unicodedata import combining, normalize

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

# Language codes of the catalogue and what they are called in recognition tools.
TOOL_LANGUAGES = {"pt": "por", "es": "spa", "en": "eng", "fr": "fra", "de": "deu", "it": "ita"}
TOKEN = "[0-9a-zà-ÿ]+"
EDGE_PUNCTUATION = ".,;:!?()[]\"'“”«»—–-…¬"
_TOKEN = re.compile(TOKEN)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once, also where f uses it inside further lambdas."""
    return F.transform(F.array(value), f)[0]


def strip(c: Column | str) -> Column:
    """Whitespace of any kind off both ends (`trim` takes only spaces)."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def one_line(c: Column | str) -> Column:
    return strip(F.regexp_replace(col(c), r"(?U)\s+", " "))


def useful_characters(c: Column | str) -> Column:
    """How many letters and digits."""
    return F.length(F.regexp_replace(col(c), r"[^\p{L}\p{N}]", ""))


def has_text(c: Column | str, least: int = 50) -> Column:
    return useful_characters(c) >= least


def preview(c: Column | str, size: int = 150) -> Column:
    line = one_line(c)
    return F.when(F.length(line) > size, F.concat(F.substring(line, 1, size), F.lit("..."))).otherwise(line)


def truncate(c: Column | str, size: int) -> Column:
    line = one_line(c)
    return F.when(F.length(line) > size, F.concat(F.regexp_replace(F.substring(line, 1, size), r"\s+$", ""), F.lit("…"))).otherwise(line)


def safe_file_name(c: Column | str) -> Column:
    return F.concat(safe_name(c), F.lit(".txt"))


def safe_name(c: Column | str) -> Column:
    """Runs of anything but letters, digits, underscores and hyphens one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(col(c), r"[^\p{L}\p{N}_\-]+", "_"), "^_+|_+$", "")


def tool_language(c: Column | str) -> Column:
    """`pt_BR` -> `por`; unknown -> ''."""
    short = F.element_at(F.split(F.regexp_replace(F.lower(F.trim(col(c))), "-", "_"), "_"), 1)
    pairs = F.create_map(*[F.lit(x) for kv in TOOL_LANGUAGES.items() for x in kv])
    return F.coalesce(F.element_at(pairs, short), F.lit(""))


def tokens(c: Column | str, least: int = 2) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(col(c)), F.lit(TOKEN), 0), lambda t: F.length(t) >= least)


def token_list(text: str, least: int = 2) -> list[str]:
    """tokens() of one text, for functions that work through whole batches."""
    return [t for t in _TOKEN.findall(text.lower()) if len(t) >= least]


def word_list(text: str) -> list[str]:
    """Words of letters only, in composed form, punctuation off their ends."""
    return [w for w in (x.strip(EDGE_PUNCTUATION) for x in normalize("NFC", text).split()) if w.isalpha()]


def bare(text: str) -> str:
    """Letters without their marks."""
    return "".join(c for c in normalize("NFD", text) if not combining(c))


@pandas_udf(StringType())
def composed(texts: pd.Series) -> pd.Series:
    """Unicode's composed form (NFC)."""
    return texts.map(lambda t: normalize("NFC", t), na_action="ignore")


@pandas_udf(ArrayType(StringType()))
def decomposed(texts: pd.Series) -> pd.Series:
    """Each text of a list without its case, in compatibility decomposed form (NFKD)."""
    return texts.map(lambda ts: [None if t is None else normalize("NFKD", t.casefold()) for t in ts], na_action="ignore")


@pandas_udf(ArrayType(StringType()))
def words(texts: pd.Series) -> pd.Series:
    """word_list() of each text; null for null."""
    return texts.map(word_list, na_action="ignore")


@pandas_udf(StringType())
def strip_accents(texts: pd.Series) -> pd.Series:
    """Letters without their marks, whatever the script."""
    return texts.map(bare, na_action="ignore")


def only_accent_missing(word: Column | str, suggestion: Column | str) -> Column:
    w, s = col(word), col(suggestion)
    return (F.length(w) >= 4) & (w != s) & (strip_accents(w) == strip_accents(s))


def token_estimate(c: Column | str, characters: float = 4.0) -> Column:
    return F.ceil(F.length(col(c)) / F.lit(characters)).cast("int")


def point_id(c: Column | str) -> Column:
    """Version-5 UUID of a name in the DNS namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8109dad11d180b400c04fd430c8")), col(c).cast("binary")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def clean_markup_notes(c: Column | str) -> Column:
    """Redirects become empty; reference notes go."""
    notes = F.regexp_replace(F.regexp_replace(col(c), r"(?is)<ref[^>]*/>", ""), r"(?is)<ref[^>]*>.*?</ref>", "")
    return F.when(F.upper(F.ltrim(col(c))).startswith("#REDIRECT"), F.lit("")).otherwise(strip(notes))


def title_of(content: Column | str) -> Column:
    first = F.element_at(F.split(col(content), "\n", 3), 1)
    return F.when(first.startswith("#"), strip(F.regexp_replace(first, "^#+", ""))).otherwise(F.lit("desconhecido"))


def body_of(content: Column | str) -> Column:
    return F.coalesce(F.try_element_at(F.split(col(content), "\n", 3), F.lit(3)), F.lit(""))
