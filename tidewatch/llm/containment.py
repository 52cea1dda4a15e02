"""Test items inside documents: size-partitioned MinHash containment search, in built-in functions only.

A document's sketch is the smallest shingle hash in each of its bins, and it has at least twice as many
bins as shingles: documents are partitioned by size into powers of two, and every partition has its own
resolution. So a short item inside a long document still leaves its mark: each shared shingle is the
smallest of its bin with a probability of at least ``KEPT``, whatever the document's size. Items are
partitioned by size too: those of few shingles, of which a sketch could miss all, are also looked up
among the document's other shingles. Pairs whose hits allow the containment asked for are verified on
the words themselves.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import written

WORDS = 5
CONTAINMENT = 0.8
# (1 - exp(-x)) / x with at most x = 1/2 shingles a bin.
KEPT = 0.78
FEW = 24  # items of fewer shingles are looked up in full
# Up to this many shingles of all items are broadcast (16 bytes each); beyond it the join is shuffled.
BROADCAST_SHINGLES = 1_000_000


def words(text: Column) -> Column:
    """Words without ASCII white space, A-Z lower-cased."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(low, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def _windows(column: str, width: int, make) -> Column:
    """``make`` of every run of ``width`` entries of an array column."""
    last = F.size(column) - width
    runs = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: make(*[F.get(column, i + k) for k in range(width)]))
    return F.when(last >= 0, F.array_distinct(runs))


def _hashed(rows: DataFrame, text: str, width: int) -> DataFrame:
    """With ``_set``: the sorted different shingle hashes; null where there are too few words.

    No condition on the new columns may follow: the optimizer would move it below them, and with it
    a copy of the words' expression into every step of the windows.
    """
    coded = rows.withColumn("_coded", F.transform(words(F.col(text)), lambda w: F.xxhash64(w)))
    return coded.withColumn("_set", F.sort_array(_windows("_coded", width, F.xxhash64))).drop("_coded")


def _marked(docs: DataFrame) -> DataFrame:
    """A row per shingle hash; ``least``: it is the smallest of its bin, which its leading bits name."""
    partition = F.ceil(F.log2(F.greatest(F.size("_set"), F.lit(1)))).cast("int")
    sized = docs.withColumn("_shift", F.lit(63) - partition)
    bin_of = lambda h: F.call_function("shiftrightunsigned", h, F.col("_shift"))
    first = lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get("_set", i - 1)))
    marks = F.transform("_set", lambda h, i: F.struct(h.alias("hash"), first(h, i).alias("least")))
    return sized.select("doc_id", "text_hash", F.inline_outer(marks))


def _sized(items: DataFrame) -> DataFrame:
    """Behind a count of its rows a broadcast, beyond that a plain join."""
    return F.broadcast(items) if items.count() <= BROADCAST_SHINGLES else items


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    containment: float = CONTAINMENT,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """Pairs of a document and an item of whose different five-word shingles it holds the given share.

    Returns doc_id, text_hash (xxhash64 of the text, which tells rows with one id apart), item_id, ``shingles``
    of the item, ``shared`` and ``containment``; each pair once, repeated rows too. An item of one to four
    words is one shingle of all its words. Missing and empty texts hold nothing, and items without words
    are in nothing. Rows without an id are searched as well. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    tests = items.select(
        F.col(item_column).alias("item_id"), F.coalesce(F.col(item_text_column), F.lit("")).alias("item_text")
    ).distinct()
    tests = tests.withColumn("_width", F.least(F.size(words(F.col("item_text"))), F.lit(WORDS))).where("_width > 0")
    widths = sorted(r["_width"] for r in tests.select("_width").distinct().collect())
    found = [_contaminated(rows, tests.where(F.col("_width") == w), w, containment) for w in widths]
    if not found:  # no item has words
        ids = f"doc_id long, text_hash long, item_id {dict(items.dtypes)[item_column]}"
        return docs.sparkSession.createDataFrame([], f"{ids}, shingles int, shared int, containment double")
    return reduce(DataFrame.union, found)


def _contaminated(docs: DataFrame, tests: DataFrame, width: int, containment: float) -> DataFrame:
    shingled = _hashed(tests, "item_text", width)
    listed = shingled.select("item_id", "item_text", F.size("_set").alias("q"), F.explode_outer("_set").alias("hash"))
    listed = listed.select("hash", "item_id", F.xxhash64("item_text").alias("item_hash"), "q")
    marks = _marked(_hashed(docs, "text", width)).join(_sized(listed), "hash").where(F.col("least") | (F.col("q") < FEW))
    hits = marks.groupBy("doc_id", "text_hash", "item_id", "item_hash", "q").agg(F.count("*").alias("hits"))
    # Half the hits expected at the containment asked for; never under one.
    likely = hits.where(F.col("hits") >= F.greatest(F.lit(1.0), F.col("q") * (containment * KEPT / 2)))

    # A row twice in ``docs`` has its hits counted twice, but is verified once.
    named = written(likely.select("doc_id", "text_hash", "item_id", "item_hash"), "likely")
    wanted = named.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    texts = docs.join(wanted, same, "left_semi").dropDuplicates(["doc_id", "text_hash"])
    join = lambda *w: F.concat_ws(" ", *w)
    spelt = texts.withColumn("_words", words(F.col("text"))).select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), _windows("_words", width, join).alias("_doc")
    )
    asked = tests.withColumn("_words", words(F.col("item_text"))).select(
        F.col("item_id").alias("_item"), F.xxhash64("item_text").alias("_item_hash"), _windows("_words", width, join).alias("_test")
    )
    pairs = named.join(spelt, same).join(asked, F.col("item_id").eqNullSafe(F.col("_item")) & (F.col("item_hash") == F.col("_item_hash")))
    counted = pairs.select(
        "doc_id", "text_hash", "item_id", F.size("_test").alias("shingles"), F.size(F.array_intersect("_test", "_doc")).alias("shared")
    )
    share = F.col("shared") / F.col("shingles")
    return counted.withColumn("containment", share).where(F.col("shared") >= containment * F.col("shingles") - 1e-9)
