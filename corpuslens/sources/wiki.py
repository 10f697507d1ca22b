"""A wiki's pages as a Spark data source: titles are listed on the driver, texts are fetched in batches by the executors."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from urllib.parse import urlencode
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import text as fn
from .providers import ProviderError, retried

PER_REQUEST, LISTED, LEAST = 50, 500, 80

Fetch = Callable[[str, dict], dict]


def http(url: str, parameters: dict) -> dict:
    """One request; failures carry their status."""
    from urllib.error import HTTPError, URLError

    try:
        with urlopen(Request(f"{url}?{urlencode({**parameters, 'format': 'json'})}", headers={"User-Agent": "corpuslens"}), timeout=30) as r:  # noqa: S310
            return json.load(r)
    except HTTPError as e:
        raise ProviderError(str(e), e.code) from e
    except URLError as e:
        raise ProviderError(str(e)) from e


def namespace_id(fetch: Fetch, url: str, name: str) -> int:
    known = fetch(url, {"action": "query", "meta": "siteinfo", "siprop": "namespaces"})["query"]["namespaces"]
    for number, about in known.items():
        if name in (about.get("*"), about.get("canonical")):
            return int(number)
    raise ProviderError(f"the wiki has no namespace {name!r}")


def titles(fetch: Fetch, url: str, namespace: int, limit: int) -> Iterator[str]:
    """Titles of a namespace without redirects, at most `limit`, a listing at a time."""
    found, after = 0, None
    while found < limit:
        asked = {"action": "query", "list": "allpages", "apnamespace": namespace, "apfilterredir": "nonredirects", "aplimit": min(LISTED, limit - found)}
        got = fetch(url, asked | ({"apcontinue": after} if after else {}))
        listed = [p["title"] for p in got.get("query", {}).get("allpages", [])][: limit - found]
        yield from listed
        found += len(listed)
        after = got.get("continue", {}).get("apcontinue")
        if not after or not listed:
            return


def texts(fetch: Fetch, url: str, wanted: list[str]) -> Iterator[tuple[str, str]]:
    """(title, markup) of up to 50 pages; pages that don't exist are left out."""
    got = fetch(url, {"action": "query", "prop": "revisions", "rvprop": "content", "rvslots": "main", "titles": "|".join(wanted)})
    for page in got.get("query", {}).get("pages", {}).values():
        for revision in page.get("revisions", [])[:1]:
            yield page["title"], revision.get("slots", {}).get("main", {}).get("*", "")


class Titles(InputPartition):
    def __init__(self, wanted: list[str]):
        super().__init__(0)
        self.wanted = wanted


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], fetch: Fetch):
        self.options, self.fetch = options, fetch

    def partitions(self) -> list[Titles]:
        o, call = self.options, retried(self.fetch)
        limit, size = int(o.get("limit", "1000")), min(PER_REQUEST, int(o.get("batch", str(PER_REQUEST))))
        skip = set(json.loads(o.get("skip", "[]")))
        wanted = [t for t in titles(call, o["url"], namespace_id(call, o["url"], o.get("namespace", "")), limit) if t not in skip]
        return [Titles(wanted[i : i + size]) for i in range(0, len(wanted), size)]

    def read(self, partition: Titles) -> Iterator[tuple[str, str, str | None]]:
        """A batch that fails is one row with the error, not the end of the job."""
        try:
            for title, markup in texts(retried(self.fetch), self.options["url"], partition.wanted):
                yield title, markup, None
        except ProviderError as e:
            yield "|".join(partition.wanted), None, str(e)


def source(fetch: Fetch = http) -> type[DataSource]:
    """The data source class `wiki`, to register with spark.dataSource.register()."""

    class Wiki(DataSource):
        @classmethod
        def name(cls) -> str:
            return "wiki"

        def schema(self) -> str:
            return "titulo string, marcacao string, erro string"

        def reader(self, schema) -> DataSourceReader:
            return Reader(dict(self.options), fetch)

    return Wiki


def download(spark: SparkSession, present: DataFrame, least: int = LEAST, fetch: Fetch = http, **options: str) -> tuple[DataFrame, DataFrame]:
    """Pages not in `present` (documento_origem), cleaned, of `least` characters at least, as (documento_origem, titulo_pagina, corpo, conteudo);
    and the batches that failed. Listing comes first, then an anti-join by file name, then requests."""
    call, limit = retried(fetch), int(options.get("limit", "1000"))
    listed = [(t,) for t in titles(call, options["url"], namespace_id(call, options["url"], options.get("namespace", "")), limit)]
    wanted = spark.createDataFrame(listed, "titulo string").withColumn("documento_origem", fn.safe_file_name("titulo")).join(present.select("documento_origem"), "documento_origem", "left_anti")
    size = min(PER_REQUEST, int(options.get("batch", str(PER_REQUEST))))
    batches = wanted.withColumn("b", F.floor(F.monotonically_increasing_id() / size)).groupBy("b").agg(F.collect_list("titulo").alias("t"))
    url = options["url"]

    def run(frames):
        import pandas as pd

        for f in frames:
            rows = []
            for asked in f["t"]:
                try:
                    rows += [(t, m, None) for t, m in texts(retried(fetch), url, list(asked))]
                except ProviderError as e:
                    rows.append(("|".join(asked), None, str(e)))
            yield pd.DataFrame(rows, columns=["titulo", "marcacao", "erro"])

    got = batches.mapInPandas(run, "titulo string, marcacao string, erro string")
    body = fn.clean_markup_notes("marcacao")
    pages = got.filter("erro is null").select(fn.safe_file_name("titulo").alias("documento_origem"), F.col("titulo").alias("titulo_pagina"), body.alias("corpo"))
    pages = pages.filter(F.length("corpo") >= least).withColumn("conteudo", F.concat(F.lit("# "), "titulo_pagina", F.lit("\n\n"), "corpo"))
    return pages, got.filter("erro is not null").select("titulo", "erro")
