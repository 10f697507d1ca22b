"""The training-data operators' queries, each over its whole table, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, jaccard, langid, media, mixing, packing, pii, quality, substring, toxicity
from .common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), pii.session_key(spark))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_webp_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.as_media(table(spark, sf_dir, "documents"), with_media=False).drop("media")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


WORDS = r"list_filter(string_split_regex(coalesce({}, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

REPEATS = f"""WITH w AS (SELECT row_number() OVER () AS row, doc_id, {WORDS.format('text')} AS ws FROM documents),
win AS (SELECT row, doc_id, i, md5(array_to_string(ws[i:i + 12], ' ')) AS h FROM (SELECT *, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
least_doc AS (SELECT h, min(doc_id) AS d FROM win GROUP BY h),
gone AS (SELECT DISTINCT row, unnest(range(i, i + 13)) AS k FROM win JOIN least_doc USING (h) WHERE d < doc_id),
kept AS (SELECT row, string_agg(word, ' ' ORDER BY k) AS t, count(*) AS n FROM (SELECT row, unnest(range(1, len(ws) + 1)) AS k, unnest(ws) AS word FROM w) ANTI JOIN gone USING (row, k) GROUP BY row)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (row)"""

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LINKED = f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(LOWER)} AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 3 THEN list_sort(list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
node AS MATERIALIZED (SELECT md5(array_to_string(sh, chr(10))) AS k, min(doc_id) AS d, any_value(sh) AS sh, any_value(len(sh)) AS n FROM s WHERE len(sh) > 0 GROUP BY k),
el AS MATERIALIZED (SELECT d, n, unnest(sh) AS h FROM node),
link AS MATERIALIZED (SELECT x, y FROM (SELECT a.d AS x, b.d AS y, any_value(a.n + b.n) AS u, count(*) AS c FROM el a JOIN el b ON a.h = b.h AND a.d < b.d AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n) GROUP BY ALL) WHERE 100 * c >= 90 * (u - c)),
both_ways AS MATERIALIZED (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach(d, r) AS (SELECT d, d FROM node UNION SELECT b.y, reach.r FROM reach JOIN both_ways b ON b.x = reach.d),
root AS (SELECT d, min(r) AS r FROM reach GROUP BY d)
SELECT doc_id, len(s.sh)::BIGINT AS n_shingles, coalesce(r, doc_id) AS component_id FROM s LEFT JOIN node ON k = md5(array_to_string(s.sh, chr(10))) AND len(s.sh) > 0 LEFT JOIN root USING (d)"""


def oracle_sql() -> dict[str, str]:
    """Where SQL can express the operator; the others are held against brute force in tests/llm."""
    return {"op2_substring_dedup": REPEATS, "op6_jaccard_join": LINKED}
