"""The page store: PAGE XML, form-feed texts, which version of a page holds, transcriptions and candidates."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import UTC, datetime
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..functions import text as fn
from ..operators import regions

# The format's namespace and schema, and the spellings of a region's type.
SPACE = "http://schema.primaresearch.org/PAGE/gts/pagecontent/2019-07-15"
XSI = "http://www.w3.org/2001/XMLSchema-instance"
SCHEMA = f"{SPACE} {SPACE}/pagecontent.xsd"
TYPE_IN_CUSTOM = re.compile(r"(?:structure|type)\s*\{[^}]*?\btype\s*:\s*([^;}]+)")
TEXT_SYNONYMS = ("", "text", "default", "texto", "paragraph")
PAGE_BREAK = "\f"

Points = list[dict[str, int]]


class PageError(ValueError):
    pass


def _tag(name: str) -> str:
    return f"{{{SPACE}}}{name}"


def _points(node: ET.Element, child: str = "Coords") -> Points:
    found = node.find(_tag(child))
    text = found.get("points", "") if found is not None else ""
    return [{"x": int(float(x)), "y": int(float(y or 0))} for x, _, y in (p.partition(",") for p in text.split())]


def _said(node: ET.Element) -> tuple[str, float | None]:
    text, conf = node.findtext(f"{_tag('TextEquiv')}/{_tag('Unicode')}") or "", None
    if (equivalent := node.find(_tag("TextEquiv"))) is not None and equivalent.get("conf"):
        conf = float(equivalent.get("conf", ""))
    return text, conf


def region_type(node: ET.Element) -> str:
    named = TYPE_IN_CUSTOM.search(node.get("custom", ""))
    kind = named[1].strip() if named else node.get("type", "")
    return regions.TEXT if kind.lower() in TEXT_SYNONYMS else kind


def _line(node: ET.Element) -> dict:
    text, conf = _said(node)
    words = [{"texto": t, "contorno": _points(w), "confianca": c} for w in node.findall(_tag("Word")) for t, c in [_said(w)] if t.strip()]
    return {"id": node.get("id", ""), "texto": text, "contorno": _points(node), "linha_de_base": _points(node, "Baseline"), "palavras": words, "confianca": conf}


def parse(xml: str | bytes) -> dict:
    """One page: regions in reading order, those that it doesn't name last; words of nothing but space go."""
    page = ET.fromstring(xml).find(_tag("Page"))
    if page is None:
        raise PageError("there is no Page element")
    named = page.findall(f"{_tag('ReadingOrder')}/{_tag('OrderedGroup')}/{_tag('RegionRefIndexed')}")
    place = {r.get("regionRef", ""): i for i, r in enumerate(sorted(named, key=lambda r: int(r.get("index", "0"))))}
    found = [{"id": r.get("id", ""), "tipo": region_type(r), "contorno": _points(r), "linhas": [_line(x) for x in r.findall(_tag("TextLine"))]} for r in page.iter(_tag("TextRegion"))]
    found.sort(key=lambda r: place.get(r["id"], len(place)))
    return {"largura": int(page.get("imageWidth", "0")), "altura": int(page.get("imageHeight", "0")), "imagem": page.get("imageFilename", ""), "regioes": found}


def _rectangle(lines: list[dict]) -> Points:
    points = [p for x in lines for p in (x["contorno"] or x["linha_de_base"] or [{"x": 0, "y": 0}])]
    if not points:
        return []
    (x0, x1), (y0, y1) = ((min(v), max(v)) for v in ([p[c] for p in points] for c in "xy"))
    return [{"x": x, "y": y} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]


def render(page: dict, creator: str = "corpuslens", at: str | None = None) -> str:
    """PAGE XML of one page, with its reading order; what has no outline gets one (a region its lines' rectangle, else a point at the origin)."""
    ET.register_namespace("", SPACE)
    ET.register_namespace("xsi", XSI)
    at = at or datetime.now(UTC).isoformat(timespec="seconds")

    def add(parent: ET.Element, name: str, text: str | None = None, **attributes: str) -> ET.Element:
        node = ET.SubElement(parent, _tag(name), {k: v for k, v in attributes.items() if v})
        node.text = text
        return node

    def outline(parent: ET.Element, points: Points, name: str = "Coords") -> None:
        add(parent, name, points=" ".join(f"{p['x']},{p['y']}" for p in points) or "0,0")

    def said(parent: ET.Element, text: str, conf: float | None) -> None:
        add(add(parent, "TextEquiv", conf="" if conf is None else f"{conf:.4g}"), "Unicode", text)

    root = ET.Element(_tag("PcGts"), {f"{{{XSI}}}schemaLocation": SCHEMA})
    meta = add(root, "Metadata")
    for name, value in (("Creator", creator), ("Created", at), ("LastChange", at)):
        add(meta, name, value)
    body = add(root, "Page", imageFilename=page["imagem"] or "pagina.png", imageWidth=str(page["largura"]), imageHeight=str(page["altura"]))
    if page["regioes"]:
        order = add(add(body, "ReadingOrder"), "OrderedGroup", id="ordem_de_leitura")
        for i, r in enumerate(page["regioes"]):
            add(order, "RegionRefIndexed", index=str(i), regionRef=r["id"])
    for r in page["regioes"]:
        region = add(body, "TextRegion", id=r["id"], custom=f"structure {{type:{r['tipo']};}}")
        outline(region, r["contorno"] or _rectangle(r["linhas"]))
        for x in r["linhas"]:
            line = add(region, "TextLine", id=x["id"])
            outline(line, x["contorno"])
            if x["linha_de_base"]:
                outline(line, x["linha_de_base"], "Baseline")
            for i, w in enumerate(x["palavras"]):
                word = add(line, "Word", id=f"{x['id']}_p{i}")
                outline(word, w["contorno"])
                said(word, w["texto"], w["confianca"])
            said(line, x["texto"], x["confianca"])
    ET.indent(root)
    return '<?xml version="1.0" encoding="UTF-8"?>\n' + ET.tostring(root, encoding="unicode") + "\n"


def read_page_xml(files: DataFrame, xml: str = "xml") -> DataFrame:
    """Rows with a page's XML -> the same rows with largura, altura, imagem, regioes instead of it. A broken page fails the scan."""
    names = [c for c in files.columns if c != xml]
    page = StructType.fromDDL(regions.PAGE)
    kinds = [(f.name, to_arrow_type(f.dataType)) for f in page]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parsed = [parse(x) for x in b.column(len(names)).to_pylist()]
            made = [pa.array([p[n] for p in parsed], kind) for n, kind in kinds]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), *made], [*names, *(n for n, _ in kinds)])

    return files.select(*names, xml).mapInArrow(run, StructType([*files.select(*names).schema, *page]))


def write_page_xml(pages: DataFrame, creator: str = "corpuslens", at: str | None = None, xml: str = "xml") -> DataFrame:
    """Rows with largura, altura, imagem, regioes -> the same rows with the page's XML instead of them."""
    parts = ["largura", "altura", "imagem", "regioes"]
    names = [c for c in pages.columns if c not in parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(len(names) + i).to_pylist() for i in range(4)), strict=True)
            made = pa.array([render(dict(zip(parts, r, strict=True)), creator, at) for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), made], [*names, xml])

    return pages.select(*names, *parts).mapInArrow(run, pages.select(*names).schema.add(xml, "string"))


def unplaced(text: Column | str) -> Column:
    """The regions of a text without coordinates: one a block, one line a line (largura and altura are 0)."""
    blank = F.array().cast(regions.POINTS)
    kept = F.filter(F.split(fn.col(text), r"\n\s*\n"), lambda b: fn.strip(b) != "")

    def region(b: Column, i: Column) -> Column:
        name = F.concat(F.lit("r"), i.cast("string"))
        line = lambda t, j: F.struct(F.concat(name, F.lit("_l"), j.cast("string")).alias("id"), t.alias("texto"), blank.alias("contorno"), blank.alias("linha_de_base"), F.array().cast(f"array<{regions.WORD}>").alias("palavras"), F.lit(None).cast("double").alias("confianca"))
        return F.struct(name.alias("id"), F.lit(regions.TEXT).alias("tipo"), blank.alias("contorno"), F.transform(F.split(b, "\r\n|\r|\n"), line).alias("linhas"))

    return F.transform(kept, region)


# ── texts by page ──


def page_text(text: Column | str) -> Column:
    """A page as it is stored: composed, without page breaks of its own, stripped."""
    return fn.strip(F.replace(fn.composed(fn.col(text)), F.lit(PAGE_BREAK), F.lit("\n")))


def split_pages(documents: DataFrame, text: str = "texto") -> DataFrame:
    """One row a page, numbered from 1."""
    rest = [c for c in documents.columns if c != text]
    p = documents.select(*rest, F.posexplode(F.split(text, PAGE_BREAK)).alias("_i", text))
    return p.select(*rest, (F.col("_i") + 1).alias("pagina"), text)


def join_pages(pages: DataFrame, keys: list[str], text: str = "texto") -> DataFrame:
    """Pages in order, a break between two."""
    listed = F.array_sort(F.collect_list(F.struct("pagina", F.coalesce(F.col(text), F.lit("")).alias("t"))))
    return pages.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["t"]), PAGE_BREAK).alias(text), F.count("*").alias("paginas"))


def effective(wanted: DataFrame, reviewed: DataFrame, recognised: DataFrame, keys: list[str], value: str) -> DataFrame:
    """For each wanted page its reviewed version, else the recognised one, else null."""
    r, o = (d.select(*keys, F.col(value).alias(n)) for d, n in ((reviewed, "_r"), (recognised, "_o")))
    return wanted.join(r, keys, "left").join(o, keys, "left").withColumn(value, F.coalesce("_r", "_o")).drop("_r", "_o")


def qualities(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The quality records of a folder, one a document; (handle, arquivo) is their key."""
    return spark.read.schema(schema).json(path, multiLine=True, recursiveFileLookup=True, pathGlobFilter="*.qualidade.json")


def transcriptions(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """References (pagina, referencia) of base/referencias/<page>.txt and candidates (pagina, motor, candidato) of base/candidatos/<engine>/<page>.txt."""
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", "")
    engine = F.regexp_extract(F.col("_metadata.file_path"), r"/candidatos/([^/]+)/[^/]+$", 1)
    ref = spark.read.text(f"{base}/referencias/*.txt", wholetext=True).select(stem.alias("pagina"), F.col("value").alias("referencia"))
    got = spark.read.text(f"{base}/candidatos/*/*.txt", wholetext=True).select(stem.alias("pagina"), engine.alias("motor"), F.col("value").alias("candidato"))
    return ref, got


def asked_pages(wanted: DataFrame, files: DataFrame, default_language: str = "por") -> DataFrame:
    """(identificador `<handle>_<file's stem>_p<number>`) -> the file, page number and language of each; `falta`: no such file."""
    prefix, number = F.regexp_extract("identificador", r"^(.*)_p(\d+)$", 1), F.regexp_extract("identificador", r"^(.*)_p(\d+)$", 2).try_cast("int")
    stem = F.regexp_replace("arquivo", r"\.[^.]*$", "")
    known = files.select(F.concat(fn.safe_name("handle"), F.lit("_"), stem).alias("_prefix"), "handle", "arquivo", "idioma")
    j = wanted.withColumn("_prefix", prefix).withColumn("pagina", number).join(known, "_prefix", "left")
    return j.select("identificador", "handle", "arquivo", "pagina", F.coalesce(F.nullif("idioma", F.lit("")), F.lit(default_language)).alias("idioma"), (F.col("arquivo").isNull() | F.col("pagina").isNull()).alias("falta"))


def write_candidates(readings: DataFrame, path: str) -> None:
    """(motor, pagina, texto, tempo_s, idioma, confianca_media), partitioned by engine."""
    readings.write.mode("overwrite").partitionBy("motor").json(path)
