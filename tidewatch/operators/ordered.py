"""Counts in value order without sorting a whole series in one task.

The input is a histogram: one row per (series, value, ...) with counts, already
combined map-side, so a hot value is a single row. Each series is cut into value
ranges ("buckets") of about equal row counts; running sums work inside a bucket,
and what lies below it is carried in by one extra row at the bucket's head. The
ranges are ordered and ties never straddle a cut, so the result is exact for any
choice of cuts: they only set how evenly the work spreads.

Where the number of ranges is not given, it follows the histogram's own size: the histogram is
written once, and a series of more than ``LIMIT`` rows is cut into a tree of ranges, each node
into at most ``WIDTH``. Sums below a range are added up level by level, so no task is handed more
than about ``LIMIT`` rows of a series however long it is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import run_folder

LIMIT = 250_000  # histogram rows of a series in one range, about
WIDTH = 1_000  # ranges below one node of the tree
BUCKET = "_bucket"
HEAD = "_head"


def non_negative(counts: list[str]) -> Column:
    """Always true. Referencing every count in each use of the histogram keeps column
    pruning from making the uses differ, so that Spark reuses one shuffle for all."""
    condition = F.lit(True)
    for c in counts:
        condition = condition & (F.col(c) >= 0)
    return condition


def shape(rows: int, limit: int | None = None, width: int | None = None) -> tuple[int, ...]:
    """Ranges per node on each level of the tree over so many rows; none for one range."""
    ranges, width = -(-rows // (limit or LIMIT)), width or WIDTH
    if ranges <= 1:
        return ()
    depth = 1
    while width**depth < ranges:
        depth += 1
    own = next(w for w in range(2, width + 1) if w**depth >= ranges)
    return (own,) * depth


def sized(hist: DataFrame, series: str | None, requested: int | None) -> tuple[DataFrame, tuple[int, ...]]:
    """The histogram and the shape of its tree. With a requested number of ranges nothing runs; else the
    histogram is written to the shared folder, and the rows of its longest series are counted there."""
    if requested is not None:
        return hist, (requested,) if requested > 1 else ()
    spark = hist.sparkSession
    path = run_folder(spark, "histogram")
    hist.write.parquet(path)
    stored = spark.read.schema(hist.schema).parquet(path)
    sizes = stored.groupBy(*([series] if series else [])).agg(F.count("*").alias("n"))
    return stored, shape(sizes.agg(F.max("n")).first()[0] or 0)


def _cuts(rows: DataFrame, keys: list[str], value: str, ranges: int) -> DataFrame:
    shares = [i / ranges for i in range(1, ranges)]
    return rows.groupBy(*keys).agg(F.percentile_approx(value, shares, max(1000, 20 * ranges)).alias("cuts"))


def cuts_below(cuts: Column, value: Column, ranges: int) -> Column:
    """Binary search for the number of cuts below the value."""
    steps = [2**k for k in reversed(range((ranges - 1).bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda found, step: F.when(F.get(cuts, found + step - 1) < value, found + step).otherwise(found),
    )


def with_buckets(hist: DataFrame, series: str, value: str, widths: tuple[int, ...]) -> DataFrame:
    """Add the range number of ``value`` within its series.

    Cuts come from an approximate quantile sketch over histogram rows. Those of the first level are a
    scalar subquery of at most series x ranges doubles; those below are joined, one row per node.
    """
    if not widths:
        return hist.withColumn(BUCKET, F.lit(0))
    first = widths[0]
    cuts = _cuts(hist, [series], value, first).agg(
        F.map_from_entries(F.collect_list(F.struct(series, "cuts"))).alias("all_cuts")
    )
    missing = F.col(value).isNull()
    below = cuts_below(F.col("_cuts"), F.col(value), first)
    rows = (
        hist.withColumn("_cuts", cuts.scalar()[F.col(series)])
        .withColumn(BUCKET, F.when(missing, F.lit(0)).otherwise(below).cast("long"))
        .drop("_cuts")
    )
    for ranges in widths[1:]:
        nodes = _cuts(rows, [series, BUCKET], value, ranges).select(
            F.col(series).alias("_of"), F.col(BUCKET).alias("_node"), F.col("cuts").alias("_cuts")
        )
        at = (F.col(series) == F.col("_of")) & (F.col(BUCKET) == F.col("_node"))
        inner = F.when(missing | F.col("_cuts").isNull(), F.lit(0)).otherwise(cuts_below(F.col("_cuts"), F.col(value), ranges))
        rows = rows.join(nodes, at, "left").withColumn(BUCKET, F.col(BUCKET) * ranges + inner).drop("_of", "_node", "_cuts")
    return rows


def bucket_heads(rows: DataFrame, keys: list[str], counts: list[str], widths: tuple[int, ...]) -> DataFrame:
    """Per (keys, bucket): what lies below the bucket and the total of the keys.

    On every level a window spans the ranges of one node only.
    """
    sums = rows.groupBy(*keys, BUCKET).agg(*[F.sum(c).alias(c) for c in counts])
    return _heads(sums, keys, counts, widths)


def _heads(sums: DataFrame, keys: list[str], counts: list[str], widths: tuple[int, ...]) -> DataFrame:
    if len(widths) <= 1:
        everything = Window.partitionBy(*keys)
        below = everything.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
        return sums.select(
            *keys,
            BUCKET,
            *[F.coalesce(F.sum(c).over(below), F.lit(0)).alias(c) for c in counts],
            *[F.sum(c).over(everything).alias(total(c)) for c in counts],
        )
    node = sums.withColumn("_node", F.expr(f"{BUCKET} div {widths[-1]}"))
    above = node.groupBy(*keys, "_node").agg(*[F.sum(c).alias(c) for c in counts]).withColumnRenamed("_node", BUCKET)
    above = _heads(above, keys, counts, widths[:-1])
    named = above.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys],
        F.col(BUCKET).alias("_above"),
        *[F.col(c).alias(f"_below_{c}") for c in counts],
        *[total(c) for c in counts],
    )
    below = Window.partitionBy(*keys, "_node").orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    inside = node.select(*keys, BUCKET, "_node", *[F.coalesce(F.sum(c).over(below), F.lit(0)).alias(c) for c in counts])
    same = reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"_key_{k}")), keys, F.col("_node") == F.col("_above"))
    return inside.join(named, same).select(
        *keys, BUCKET, *[(F.col(c) + F.col(f"_below_{c}")).alias(c) for c in counts], *[total(c) for c in counts]
    )


def total(count: str) -> str:
    return f"{count}_total"


def at_or_below(count: str) -> str:
    return f"{count}_le"


def running_window(keys: list[str], order: list[Column]):
    """Frames "up to this row" and "whole group" on one ordering, so they share one pass."""
    ordering = Window.partitionBy(*keys, BUCKET).orderBy(*order)
    upto = ordering.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = ordering.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return upto, whole


def running_counts(
    rows: DataFrame,
    keys: list[str],
    order: list[Column],
    count: str,
    widths: tuple[int, ...],
    also: dict | None = None,
) -> DataFrame:
    """Add ``<count>_le`` (running sum in the given order) and ``<count>_total`` per keys.

    ``rows`` must carry the bucket column, and ``order`` must put NULL values first.
    With several buckets the head rows of :func:`add_heads` bring in the sums below.
    ``also`` maps further column names to functions of the running frame.
    """
    upto, whole = running_window(keys, order)
    if not widths:
        all_of_it = F.sum(count).over(whole)
    else:
        all_of_it = F.first(total(count), ignorenulls=True).over(upto)
    kept = [c for c in rows.columns if c != total(count)]
    return rows.select(
        *kept,
        F.sum(count).over(upto).alias(at_or_below(count)),
        all_of_it.alias(total(count)),
        *[column(upto).alias(name) for name, column in (also or {}).items()],
    )


def add_heads(rows: DataFrame, value: str, heads: list[DataFrame]) -> DataFrame:
    """Append head rows; their NULL value sorts them first in the bucket."""
    out = rows.withColumn(HEAD, F.lit(False))
    for head in heads:
        out = out.unionByName(head.withColumn(HEAD, F.lit(True)), allowMissingColumns=True)
    return out
