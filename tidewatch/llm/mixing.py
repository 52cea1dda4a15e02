"""Mixing sources to target weights by systematic sampling, in built-in functions only.

Sources share the words of the whole corpus by weight; none gets more than ``most`` times its own words, and
what is above goes to the others. Each document of a source expects the same number of copies, its
source's target over its size. These expectations are summed up along the documents of a source, in
order of size; one random offset is added, and a document is taken once for each whole number its stretch of
that line crosses. As sizes grow along the line, a source's words miss its target by a few documents' words.

The line is cut at blocks of ``BLOCK`` sizes, and a block of many documents at their hashes: the start of
each bucket comes from sums by bucket, so a source with a third of all rows still spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import prod

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import written

WEIGHTS = (5, 2, 1)
MOST = 3  # copies of a document, and times its size that a source may reach
UNIT = 1 << 32  # one copy in whole numbers
BLOCK = 64  # sizes that share a bucket
BUCKET_ROWS = 10_000
MOST_BUCKETS = 100_000  # by which blocks are cut; beyond that buckets hold more rows
MOST_SOURCES = 100_000  # that are broadcast; beyond it their table is joined by a shuffle
_EXACT = "decimal(38,0)"


def _number(text: Column, digits: int) -> Column:
    """The leading hexadecimal digits of a text's SHA-256 as a number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, digits), 16, 10).cast("long")


def measured(docs: DataFrame, seed: int, id_column: str, text_column: str, source_column: str) -> DataFrame:
    """doc_id, source, ``size`` in words, ``block`` of sizes, and two hashes: ``place`` in the order and ``row``."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    doc_id = F.col(id_column).cast("long")
    rows = docs.select(
        doc_id.alias("doc_id"),
        F.col(source_column).cast("string").alias("source"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
        _number(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 15).alias("place"),
        F.xxhash64(text).alias("row"),
    )
    return rows.withColumn("block", F.expr(f"size div {BLOCK}"))


def source_targets(sources: DataFrame, seed: int = 0, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) with ``target``, ``rate`` (copies of each document, in units) and ``offset``.

    Sources in order, null last, take the weights in turn. Those whose limit is reached first, by limit over
    weight, are filled; from the first that isn't, the rest shares what is left by weight. One row per
    source goes through these windows.
    """
    everything = Window.partitionBy()
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (turn + 1).cast("int"))
    named = sources.withColumn("weight", weight).withColumn("limit", (most * F.col("source_size")).cast(_EXACT))
    filling = Window.orderBy(F.col("limit") * F.expr(f"{prod(set(weights))} div weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything).cast(_EXACT) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    open_ = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    ranked = named.withColumns({"left": left.cast(_EXACT), "open": open_, "turn": F.row_number().over(filling)})
    full = F.col("limit") * F.col("open") <= F.col("weight") * F.col("left")
    judged = ranked.withColumn("full", full)
    first = F.min(F.when(~F.col("full"), F.struct("turn", "left", "open"))).over(everything)
    share = F.col("weight") * F.col("first.left").cast("double") / F.col("first.open")
    target = F.when(F.col("full"), F.col("limit").cast("double")).otherwise(share)
    shared = judged.withColumn("first", first).withColumn("target", target)
    rate = F.floor(F.col("target") / F.col("source_size") * UNIT)
    named_source = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    return shared.select(
        "source",
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.least(rate, F.lit(most * UNIT))).otherwise(0).cast("long").alias("rate"),
        _number(F.concat(F.lit(f"{seed}:"), named_source), 8).alias("offset"),
    )


def _bounded(rows: DataFrame, most: int) -> DataFrame:
    """Behind a count of its rows a broadcast, beyond that a plain join."""
    return F.broadcast(rows) if rows.count() <= most else rows


def sample(
    docs: DataFrame,
    seed: int = 0,
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST,
    bucket_rows: int = BUCKET_ROWS,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """One row per row of ``docs`` with the copies the mix takes.

    Returns doc_id, source, row (xxhash64 of the text), size (words), source_size, target (of its source, in words),
    ``copies`` (0 to ``most``) and ``taken``, the words of these copies. A missing text has no words; rows without
    a source are one source, the last. Documents without words are taken at their source's rate, which
    adds nothing. Rows without an id and repeated rows count each; which of equal rows is taken more often is open, and
    no column shows it. A corpus without words takes nothing, an empty table gives no rows. Other columns are
    ignored. The same seed and rows give the same mix, however they are dealt out.
    """
    rows = written(measured(docs, seed, id_column, text_column, source_column), "mix-sizes")
    blocks = rows.groupBy("source", "block").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    blocks = written(blocks, "mix-blocks")  # at most one row per 64 sizes and source
    sources = blocks.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = written(source_targets(sources, seed, weights, most), "mix-targets")

    total = blocks.agg(F.sum("n")).first()[0] or 0
    bucket = max(bucket_rows, total // MOST_BUCKETS)
    parts = F.ceil(F.col("n") / bucket).alias("parts")
    large = F.broadcast(blocks.where(F.col("n") > bucket).select("source", "block", parts))  # at most MOST_BUCKETS
    alike = lambda a, b, *keys: F.lit(True) & a["source"].eqNullSafe(b["source"]) & _equal(a, b, keys)
    named = rows.join(large, alike(rows, large, "block"), "left").drop(large["source"], large["block"])
    part = F.shiftright(F.shiftright("place", 30) * F.coalesce("parts", F.lit(1)), 30)
    known = _bounded(targets, MOST_SOURCES)
    dealt = named.withColumn("part", part).drop("parts")
    dealt = dealt.join(known, alike(dealt, known)).drop(known["source"])

    sums = dealt.groupBy("source", "block", "part").agg(F.sum(F.col("rate").cast(_EXACT)).alias("step"))
    before = Window.partitionBy("source").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1)
    # Whole copies before a bucket leave its own numbers as they are.
    base = F.coalesce(F.sum("step").over(before), F.lit(0)).cast(_EXACT)
    starts = sums.select("source", "block", "part", F.pmod(base, F.lit(UNIT).cast(_EXACT)).cast("long").alias("base"))
    starts = starts.hint("merge")  # as many as buckets: never a broadcast
    line = dealt.join(starts, alike(dealt, starts, "block", "part")).drop(starts["source"], starts["block"], starts["part"])
    inside = Window.partitionBy("source", "block", "part").orderBy("size", "place", "doc_id", "row")
    reached = F.col("base") + F.col("offset") + F.sum("rate").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    crossed = line.withColumn("reached", reached)
    copies = F.expr(f"reached div {UNIT} - (reached - rate) div {UNIT}")
    return crossed.select(
        "doc_id", "source", "row", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def _equal(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & (a[k] == b[k])
    return out


def mix(docs: DataFrame, seed: int = 0, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as ``sample`` takes it, with a ``copy`` number from 0.

    A column of that name is replaced. Of equal rows (id, source and text) one stands for all, as often as
    they are taken together.
    """
    names = {"id_column": id_column, "text_column": text_column, "source_column": source_column}
    taken = sample(docs, seed, **names, **options).groupBy("doc_id", "source", "row").agg(F.sum("copies").alias("copies"))
    taken = taken.where("copies > 0").select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("row").alias("_row"), "copies")
    taken = taken.withColumnRenamed("copies", "_copies").hint("merge")
    keys = {
        "_own_id": F.col(id_column).cast("long"),
        "_own_source": F.col(source_column).cast("string"),
        "_own_row": F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))),
    }
    keyed = docs.withColumns(keys).dropDuplicates(list(keys))
    same = [keyed[f"_own{k}"].eqNullSafe(taken[k]) for k in ("_id", "_source", "_row")]
    found = keyed.join(taken, same)
    repeated = found.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_copies").cast("int") - 1)))
    return repeated.select(*[c for c in docs.columns if c != "copy"], "copy")
