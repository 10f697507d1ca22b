"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

Sources in code-point order (null last) weigh 1, 2, 3, repeating, and share the corpus's words; a target stops at
`limit` times its source's size and the excess is shared again by weight (water filling). Equal blocks of words go to
the sources by highest quotients; each source's quota goes in the same way to its shards; a shard takes whole rounds
of all its documents, then picks its other blocks by a seeded permutation, its documents being in a seeded order.

Defined results: null text has size 0 and takes 0; a source without words has target 0; repeated rows are separate
documents; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, cut

SEED = 20240607


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: int = 3) -> DataFrame:
    """(source, size) -> (source, source_size, target, total). One row a source; `size` sums to `source_size`."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    s = s.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("double"))
    s = s.withColumn("_cap", (F.col("source_size") * limit).cast("double"))
    # Sources fill up in the order of cap / weight; behind a source the rest share what is left.
    by_level = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(everything))
    rest = F.col("total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    open_weight = F.sum("_w").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    s = s.withColumn("_level", rest / open_weight).withColumn("_open", F.col("_level") <= F.col("_cap") / F.col("_w"))
    s = s.withColumn("_water", F.min(F.when(F.col("_open"), F.struct((F.col("_cap") / F.col("_w")).alias("a"), F.col("_level").alias("b")))).over(everything)["b"])
    s = s.withColumn("target", F.when(F.col("_water").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_water") * F.col("_w"))))
    return s.select("source", "source_size", "n_docs", "target", "total")


def apportion(parties: DataFrame, group: list[str], votes: str, seats: Column, out: str) -> DataFrame:
    """Sainte-Lague: `seats` (one number in a group) to the group's rows by the highest quotients votes / (2 s + 1).

    All seats with a quotient of at least half a divisor are won at once, with the divisor chosen so that they can't be too
    many; the few left over (fewer than the group has rows) go one by one to the next highest quotients."""
    g = Window.partitionBy(*group)
    p = parties.withColumn("_seats", seats.cast("long")).withColumn("_all", F.sum(votes).over(g).cast("double")).withColumn("_k", F.count("*").over(g))
    free = F.col("_seats") - F.col("_k") / 2.0
    p = p.withColumn("_won", F.when((free > 0) & (F.col("_all") > 0), F.floor(F.col(votes) * free / F.col("_all") + 0.5)).otherwise(F.lit(0)).cast("long"))
    p = p.withColumn("_left", F.greatest(F.lit(0), F.col("_seats") - F.sum("_won").over(g)).cast("long"))
    # Both divisors in question differ by so little that a row wins at most its share of _k seats, and one, besides.
    more = F.least(F.col("_left"), F.ceil(F.col("_k") * F.col(votes) / F.greatest(F.col("_all"), F.lit(1e-300))) + 2).cast("int")
    names = parties.columns
    bids = p.filter((F.col(votes) > 0) & (F.col("_left") > 0)).withColumn("_j", F.explode(F.sequence(F.lit(0), F.greatest(more - 1, F.lit(0)))))
    bids = bids.withColumn("_q", F.col(votes) / (2 * (F.col("_won") + F.col("_j")) + 1))
    order = Window.partitionBy(*group).orderBy(F.col("_q").desc(), *[F.col(c).asc_nulls_last() for c in names if c not in group and c != votes])
    extra = bids.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= F.col("_left"))
    keys = [c for c in names if c != votes]
    extra = extra.groupBy(*keys).agg(F.count("*").alias("_more"))
    on = [F.col(f"p.{c}").eqNullSafe(F.col(f"x.{c}")) for c in keys]
    joined = p.alias("p").join(extra.alias("x"), on, "left")
    return joined.select(*[F.col(f"p.{c}").alias(c) for c in names], (F.col("p._won") + F.coalesce(F.col("x._more"), F.lit(0))).cast("long").alias(out))


# Odd primes above any number of blocks a shard can have: multiplying by one permutes the blocks.
STRIDES = (2147483647, 2147483629, 2147483587, 2147483579)
FEW = 200_000  # tables of at most so many small rows are broadcast


def _small(table: DataFrame) -> DataFrame:
    """`table` with a broadcast hint if its counted rows allow it."""
    return F.broadcast(table) if table.count() <= FEW else table


def _name(source: str = "source") -> Column:
    """The source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))


def plan(slim: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: int = 3, seed: int = SEED, block_words: int = 512, shard_docs: int = 2_000, most_shards: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """Of slim rows (doc_id, source, size): the sources (_s, source_size, target, block, n_shards), and their shards
    (_s, _h, shard_size, rounds, picks, stride, shift): whole rounds of all the shard's words, and how many blocks are picked besides."""
    goal = targets(slim.select("source", "size"), weights, limit)
    block = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.col("total") / (1000 * F.count("*").over(Window.partitionBy())))))
    goal = goal.withColumn("block", block.cast("long")).withColumn("_one", F.lit(1))
    quota = apportion(goal.select("_one", "source", "target", "block", "total", "source_size", "n_docs"), ["_one"], "target", F.round(F.col("total") / F.col("block")), "quota")
    n_shards = F.least(F.lit(most_shards), F.ceil(F.col("n_docs") / F.lit(shard_docs))).cast("long")
    sources = cut(quota.select(_name().alias("_s"), "source_size", "target", "block", "quota", n_shards.alias("n_shards")))
    few = _small(sources)
    d = slim.withColumn("_s", _name()).join(few, "_s").withColumn("_h", _shard(seed))
    shards = d.groupBy("_s", "_h").agg(F.sum("size").alias("shard_size")).join(few.select("_s", "block", "quota"), "_s")
    shards = apportion(shards, ["_s"], "shard_size", F.first("quota").over(Window.partitionBy("_s")), "blocks")
    # No document over `limit` times: a shard's words stop there too.
    shards = shards.withColumn("words", F.least(F.col("blocks") * F.col("block"), F.col("shard_size") * limit))
    shards = shards.withColumn("rounds", F.when(F.col("shard_size") > 0, F.floor(F.col("words") / F.col("shard_size"))).otherwise(0).cast("long"))
    shards = shards.withColumn("n_blocks", F.ceil(F.col("shard_size") / F.col("block")).cast("long"))
    left = F.round((F.col("words") - F.col("rounds") * F.col("shard_size")) / F.col("block"))
    seeded = lambda k: F.xxhash64(F.lit(seed + k), "_s", "_h")
    stride = F.element_at(F.array(*map(F.lit, STRIDES)), (F.pmod(seeded(2), F.lit(len(STRIDES))) + 1).cast("int")).cast("long")
    shards = shards.select("_s", "_h", "shard_size", "rounds", "n_blocks", F.least(left, F.col("n_blocks")).cast("long").alias("picks"), stride.alias("stride"), F.pmod(seeded(3), F.greatest(F.col("n_blocks"), F.lit(1))).alias("shift"))
    return sources.select("_s", "source_size", "target", "block", "n_shards"), cut(shards)


def _shard(seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc_id").cast("string")), F.col("n_shards"))


def place(rows: DataFrame, sources: DataFrame, shards: DataFrame, tie: Column, seed: int = SEED) -> DataFrame:
    """`rows` (doc_id, source, size, ...) with source_size, target, `rounds` (times that the whole document is taken), `spans`
    (word ranges [a, b) taken once more: where the picked blocks of its shard lie in it) and `taken`.

    One shuffle of the rows, by shard; the sources' and shards' tables are broadcast if they are small, else they follow the rows."""
    d = rows.withColumn("_s", _name()).join(_small(sources), "_s").withColumn("_h", _shard(seed))
    order = Window.partitionBy("_s", "_h").orderBy(F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")), F.col("doc_id").asc_nulls_last(), "size", tie)
    d = d.withColumn("_to", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_at", F.col("_to") - F.col("size"))
    d = d.join(_small(shards), ["_s", "_h"])

    def picked(i: Column) -> Column:
        return F.pmod(i * F.col("stride") + F.col("shift"), F.greatest(F.col("n_blocks"), F.lit(1))) < F.col("picks")

    first, last = F.floor(F.col("_at") / F.col("block")).cast("long"), F.floor((F.col("_to") - 1) / F.col("block")).cast("long")
    blocks = F.when((F.col("size") > 0) & (F.col("picks") > 0), F.sequence(first, last)).otherwise(F.array().cast("array<long>"))
    d = d.withColumn("_blocks", blocks)
    # Neighbouring picked blocks make one span.
    begins = F.filter("_blocks", lambda i: picked(i) & ((i == first) | ~picked(i - 1)))
    ends = F.filter("_blocks", lambda i: picked(i) & ((i == last) | ~picked(i + 1)))
    span = lambda x, y: F.struct(
        (F.greatest(x * F.col("block"), F.col("_at")) - F.col("_at")).alias("a"), (F.least((y + 1) * F.col("block"), F.col("_to")) - F.col("_at")).alias("b")
    )
    d = d.withColumn("spans", F.zip_with(begins, ends, span))
    extra = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["b"] - s["a"])
    d = d.withColumn("taken", (F.col("rounds") * F.col("size") + extra).cast("long"))
    return d.drop("_s", "_h", "_to", "_at", "_blocks", "shard_size", "n_blocks", "picks", "stride", "shift", "block", "n_shards")


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, source for every row of `docs` (doc_id, text, source)."""
    slim = cut(docs.select("doc_id", "source", n_words().alias("size"), F.xxhash64("text").alias("tie")))
    return place(slim, *plan(slim, **options), F.col("tie"), options.get("seed", SEED)).select("doc_id", "size", "source_size", "target", "taken", "source")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus itself: whole copies of each document and, where blocks are picked inside it, the words of these.

    Rows keep the columns of `docs`; n_chars follows the text. Words of a cut row are joined by one space. Rows of one id are put in
    order by a hash of all their columns, so reruns agree."""
    names = docs.columns
    plans = plan(cut(docs.select("doc_id", "source", n_words().alias("size"))), **options)
    simple = [c for c in names if docs.schema[c].dataType.typeName() not in ("map", "variant")]
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "source", n_words().alias("size"), F.xxhash64(*simple).alias("tie"))
    placed = place(rows, *plans, F.col("tie"), options.get("seed", SEED)).filter("taken > 0").select("row", "size", "rounds", "spans")
    whole = F.array_repeat(F.struct(F.lit(0).cast("long").alias("a"), F.col("size").alias("b")), F.col("rounds").cast("int"))
    rows = placed.withColumn("span", F.explode(F.concat(whole, F.col("spans"))))
    words = F.filter(F.split(F.col("row.text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    part = F.array_join(F.slice(words, (F.col("span.a") + 1).cast("int"), (F.col("span.b") - F.col("span.a")).cast("int")), " ")
    uncut = (F.col("span.a") == 0) & (F.col("span.b") == F.col("size"))
    out = {c: F.col("row").getField(c) for c in names}
    out["text"] = F.when(uncut, F.col("row.text")).otherwise(part)
    rows = rows.select(*[v.alias(c) for c, v in out.items()])
    if "n_chars" in names:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows
