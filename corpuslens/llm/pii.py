"""Format-preserving pseudonyms for personal data.

Card numbers, phone numbers, social security numbers, IBANs, IP addresses, dates and e-mail addresses are found and
validated, and each is replaced by another valid one of the same format: a keyed Feistel permutation over the numbers
that the format allows. It is a permutation, so different values stay different, and equal values get equal pseudonyms
in whatever document and layout they stand (separators are kept, digits are permuted). Slashed dates are read day first
unless the second number is over 12.

The caller gives the key; who holds it can invert the permutation (direction "backward").

Defined results: null text stays null; text without personal data is returned unchanged; other columns are kept.
"""

from __future__ import annotations

import bisect
import hashlib
import hmac
import ipaddress
import re
import secrets
from collections.abc import Callable, Iterator
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import giving_back
from pyspark.sql import types as T

# The one- and two-digit country calling codes of E.164; all others have three digits.
ONE_DIGIT_CODES = {"1", "7"}
TWO_DIGIT_CODES = {*"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}


def session_key(spark: SparkSession) -> bytes:
    """The secret that the session names in `spark.corpuslens.pii.key`. Without one a random key is drawn for this call: values stay
    linked within its result, nobody can invert them, and another run gives other pseudonyms."""
    named = spark.conf.get("spark.corpuslens.pii.key", None)
    return named.encode() if named else secrets.token_bytes(32)


class Feistel:
    """A keyed permutation of 0 .. size-1: eight balanced rounds on the next even number of bits, walking the cycle back into range."""

    def __init__(self, key: bytes, tweak: str, size: int, rounds: int = 8):
        self.size, self.half = size, max(1, ((size - 1).bit_length() + 1) // 2)
        self.mask, self.bytes = (1 << self.half) - 1, max(16, (self.half + 7) // 8)
        base = hmac.new(key, f"{tweak}:{size}".encode(), "sha256").digest()
        self.keys = [base + bytes([i]) for i in range(rounds)]

    def _f(self, key: bytes, x: int) -> int:
        return int.from_bytes(hashlib.blake2b(x.to_bytes(self.bytes, "little"), key=key, digest_size=self.bytes).digest(), "little") & self.mask

    def _once(self, x: int, keys: list[bytes]) -> int:
        a, b = x >> self.half, x & self.mask
        for k in keys:
            a, b = b, a ^ self._f(k, b)
        return b << self.half | a

    def forward(self, x: int) -> int:
        x = self._once(x, self.keys)
        while x >= self.size:
            x = self._once(x, self.keys)
        return x

    def backward(self, x: int) -> int:
        x = self._once(x, self.keys[::-1])
        while x >= self.size:
            x = self._once(x, self.keys[::-1])
        return x


def luhn(digits: str) -> int:
    """The check digit that follows `digits`."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 * (d > 9)
    return -total % 10


def refill(shape: str, digits: str) -> str:
    """`digits` in the places that the digits of `shape` have."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def only_digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)
DAYS = (LAST_DAY - FIRST_DAY).days + 1
DAYS_UP_TO_12 = [i for i in range(DAYS) if (FIRST_DAY + timedelta(i)).day <= 12]
DAYS_AFTER_12 = [i for i in range(DAYS) if (FIRST_DAY + timedelta(i)).day > 12]


class Masker:
    """Finds, validates and permutes. `direction` is forward (pseudonyms) or backward (originals)."""

    def __init__(self, key: bytes, direction: str = "forward"):
        self.key, self.direction, self.made, self.memo = key, direction, {}, {}
        kinds: list[tuple[str, str, Callable[[str], str | None]]] = [
            ("email", r"[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9\-]*\.)+[A-Za-z]{2,24}\b", self.email),
            ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", self.iban),
            ("date", r"(?<![\d.\-/])(?:(?:19|20)\d\d-\d\d-\d\d|(?:19|20)\d\d/\d\d/\d\d|\d\d/\d\d/(?:19|20)\d\d|\d\d\.\d\d\.(?:19|20)\d\d)(?![\d\-/]|\.\d)", self.day),
            ("ip", r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)", self.ip),
            ("ssn", r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])", self.ssn),
            ("phone", r"(?<![\w+])\+1[ .\-]?\(?\d{3}\)?[ .\-]?\d{3}[ .\-]?\d{4}(?!\d)|(?<![\w+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}(?!\d|\.\d)|(?<![\w+(])\(\d{3}\) ?\d{3}[\-. ]\d{4}(?!\d)|(?<![\d\-.])\d{3}[\-. ]\d{3}[\-. ]\d{4}(?![\d\-])", self.phone),
            ("card", r"(?<![\dA-Za-z])(?:\d{4}(?P<gap>[ \-])\d{4}(?P=gap)\d{4}(?P=gap)\d{4}|\d{4}[ \-]\d{6}[ \-]\d{5}|\d{13,19})(?![\dA-Za-z])", self.card),
        ]
        self.kinds = [k[0] for k in kinds]
        self.by = {n: f for n, _, f in kinds}
        self.pattern = re.compile("|".join(f"(?P<{n}>{p})" for n, p, _ in kinds))
        # Every kind holds an @ or two digits within four characters: most lines hold neither.
        self.hint = re.compile(r"@|\d[ .\-/(]{0,2}\d")

    def permute(self, tweak: str, x: int, size: int) -> int:
        f = self.made.get((tweak, size))
        if f is None:
            f = self.made[tweak, size] = Feistel(self.key, tweak, size)
        return getattr(f, self.direction)(x)

    def digits(self, tweak: str, d: str) -> str:
        return str(self.permute(tweak, int(d), 10 ** len(d))).zfill(len(d))

    def card(self, s: str) -> str | None:
        """13 to 19 digits with a right check digit keep the first digit and get a new check digit; other numbers are no cards."""
        d = only_digits(s)
        if luhn(d[:-1]) != int(d[-1]):
            return None
        body = d[0] + self.digits(f"card{d[0]}", d[1:-1])
        return refill(s, body + str(luhn(body)))

    def phone(self, s: str) -> str | None:
        """The country code stays (numbers without one are North American); the national number is permuted, so that any layout of a
        number gets the same one. North American numbers that could be dialled stay such."""
        d = only_digits(s)
        if not 7 <= len(d) <= 15:
            return None
        if s[0] == "+":
            code = d[:1] if d[:1] in ONE_DIGIT_CODES else d[:2] if d[:2] in TWO_DIGIT_CODES else d[:3]
        else:
            code = ""
        national = d[len(code) :]
        if not national:
            return None
        tweak = f"phone{code or '1'}"
        kind = self._dialled(national) if code in ("", "1") else None
        new = self.digits(tweak, national)
        while kind is not None and self._dialled(new) != kind:
            new = self.digits(tweak, new)
        return refill(s, code + new)

    @staticmethod
    def _dialled(national: str) -> bool:
        return len(national) == 10 and national[0] > "1" and national[3] > "1"

    def ssn(self, s: str) -> str | None:
        a, b, c = map(int, s.split("-"))
        if a in (0, 666) or a >= 900 or not b or not c:
            return None
        x = ((a - 1 - (a > 666)) * 99 + b - 1) * 9999 + c - 1
        x = self.permute("ssn", x, 898 * 99 * 9999)
        x, c = divmod(x, 9999)
        a, b = divmod(x, 99)
        a += 1 + (a >= 665)
        return f"{a:03d}-{b + 1:02d}-{c + 1:04d}"

    def iban(self, s: str) -> str | None:
        t = s.replace(" ", "")
        number = lambda u: int("".join(str(int(c, 36)) for c in u))
        if not 15 <= len(t) <= 34 or number(t[4:] + t[:4]) % 97 != 1:
            # A word behind the number may have been taken for its last group.
            head, gap, tail = s.rpartition(" ")
            head = self.iban(head) if gap else None
            return None if head is None else head + gap + tail
        # Letters and digits are permuted apart, each in its own places.
        body = t[4:]
        d, a = "".join(c for c in body if c.isdigit()), "".join(c for c in body if c.isalpha())
        shape = "".join("0" if c.isdigit() else "A" for c in body)
        d = self.digits(f"iban{t[:2]}{shape}", d) if d else ""
        x, letters = self.permute(f"ibanA{t[:2]}{shape}", self._base26(a), 26 ** len(a)) if a else 0, ""
        for _ in a:
            x, r = divmod(x, 26)
            letters = chr(65 + r) + letters
        di, li = iter(d), iter(letters)
        body = "".join(next(di) if c == "0" else next(li) for c in shape)
        t = t[:2] + f"{98 - number(body + t[:2] + '00') % 97:02d}" + body
        out = iter(t)
        return "".join(c if c == " " else next(out) for c in s)

    @staticmethod
    def _base26(s: str) -> int:
        x = 0
        for c in s:
            x = x * 26 + ord(c) - 65
        return x

    def ip(self, s: str) -> str | None:
        parts = s.split(".")
        if any(int(p) > 255 or p != str(int(p)) for p in parts):
            return None
        return str(ipaddress.IPv4Address(self.permute("ip", int(ipaddress.IPv4Address(s)), 1 << 32)))

    def day(self, s: str) -> str | None:
        f = re.split(r"([\-/.])", s)
        y, m, d = (0, 2, 4) if len(f[0]) == 4 else (4, 2, 0)
        swapped = f[1] == "/" and y == 4 and int(f[2]) > 12
        if swapped:  # month first
            m, d = d, m
        try:
            x = (date(int(f[y]), int(f[m]), int(f[d])) - FIRST_DAY).days
        except ValueError:
            return None
        if not 0 <= x < DAYS:
            return None
        # Days up to the 12th are permuted among themselves, and so are the others: a date gets the same pseudonym in every layout, and
        # one that is written month first can still be told from one that isn't.
        early = int(f[d]) <= 12
        days = DAYS_UP_TO_12 if early else DAYS_AFTER_12
        new = FIRST_DAY + timedelta(days[self.permute("date-12" if early else "date-31", bisect.bisect_left(days, x), len(days))])
        return refill(s, "".join({y: f"{new.year:04d}", m: f"{new.month:02d}", d: f"{new.day:02d}"}[i] for i in (0, 2, 4)))

    def email(self, s: str) -> str | None:
        """The local part's letters and digits are permuted in their places, case and punctuation kept; the domain stays."""
        local, _, domain = s.rpartition("@")
        shape, x, size = [], 0, 1
        for c in local:
            base = 10 if c.isdigit() else 26 if c.isalpha() else 1
            v = int(c) if c.isdigit() else ord(c.lower()) - 97 if c.isalpha() else 0
            shape.append((c, base))
            x, size = x * base + v, size * base
        x = self.permute("email", x, size) if size > 1 else x
        out = []
        for c, base in reversed(shape):
            x, v = divmod(x, base)
            out.append(c if base == 1 else str(v) if base == 10 else chr(97 + v).upper() if c.isupper() else chr(97 + v))
        return "".join(reversed(out)) + "@" + domain

    def __call__(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and (kind, start, length) of each in it."""
        if not self.hint.search(text):
            return text, []
        out, found, at, shift = [], [], 0, 0
        for m in self.pattern.finditer(text):
            kind, value = m.lastgroup, m[0]
            new = self.memo.get((kind, value))
            if new is None:
                new = self.by[kind](value)
                if len(self.memo) > 100_000:
                    self.memo.clear()
                self.memo[kind, value] = new if new is not None else value
                new = self.memo[kind, value]
            if new == value and self.by[kind](value) is None:
                continue
            out += [text[at : m.start()], new]
            found.append((kind, m.start() + shift, len(new)))
            shift += len(new) - len(value)
            at = m.end()
        return ("".join(out) + text[at:], found) if found else (text, [])


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType())]))


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", spans: str = "pii_spans", direction: str = "forward") -> DataFrame:
    """`docs` with the text masked and a column of what was replaced where (kind, start, length in characters)."""
    names = [c for c in docs.columns if c != spans]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(spans, SPAN)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = Masker(key, direction)
        for b in batches:
            texts, found = [], []
            for t in b.column(names.index(text)):
                new, at = mask(t.as_py()) if t.is_valid else (None, [])
                texts.append(new)
                found.append([{"kind": k, "start": s, "length": n} for k, s, n in at])
            cols = [pa.array(texts, pa.string()) if c == text else b.column(i) for i, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(found, kind)], [*names, spans])

    return docs.select(*names).mapInArrow(run, schema)


def pseudonymise_documents(docs: DataFrame, key: bytes) -> DataFrame:
    """The documents themselves, masked; n_chars follows the text."""
    out = pseudonymise(docs, key).drop("pii_spans")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
