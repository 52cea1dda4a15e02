"""Repeatable row choice: fixed-size samples and a stratified split."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.schema import TARGET

# Leading hash bits that rows are counted by: few enough that the counts stay small beside the rows.
_BUCKET_BITS = 12


def row_order(df: DataFrame, seed: int) -> Column:
    """Pseudo-random order that depends on seed and row content only, never on partitioning."""
    return F.xxhash64(F.lit(seed), *df.columns)


def sample_n(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """At most ``n`` rows without replacement; only rows up to the hash bound that holds n are ranked."""
    return sample_per_key(df.withColumn("_all", F.lit(0)), ["_all"], n, seed).drop("_all")


def sample_per_key(df: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """At most ``n`` rows of every key.

    Counts by key and leading hash bits say below which hash a key has its n rows; only
    rows up to that bound are ranked, so a key that holds most rows sends about n of them, and each task at most
    n of every key (for n up to a thousand).
    """
    hashed = df.withColumn("_hash", row_order(df, seed)).withColumn(
        "_bucket", F.shiftrightunsigned("_hash", 64 - _BUCKET_BITS)
    )
    upto = Window.partitionBy(*keys).orderBy("_bucket")
    counts = hashed.groupBy(*keys, "_bucket").agg(F.count("*").alias("n"))
    bounds = (
        counts.withColumn("before", F.sum("n").over(upto) - F.col("n"))
        .where(F.col("before") < n)
        .groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys])
        .agg(F.max("_bucket").alias("_last"))
    )
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    # One row per key: joined by key, the rows of a large key would meet in one task.
    near = hashed.join(F.broadcast(bounds), same).where(F.col("_bucket") <= F.col("_last"))
    ranked = Window.partitionBy(*keys).orderBy("_bucket", "_hash", *df.columns)
    return near.withColumn("_rank", F.row_number().over(ranked)).where(F.col("_rank") <= n).select(*df.columns)


def class_quota(sizes: DataFrame, label: str, test_size: float) -> DataFrame:
    """Test rows per class: proportional, rounded by largest remainder, adding up to
    ceil(test_size * rows). Input and output are one row per class."""
    everything = Window.partitionBy(F.lit(0))
    by_remainder = everything.orderBy(F.desc("_rest"), label)
    return (
        sizes.withColumn("_all", F.sum("size").over(everything))
        .withColumn("_test", F.ceil(F.lit(test_size) * F.col("_all")))
        .withColumn("_exact", F.col("size") * F.col("_test") / F.col("_all"))
        .withColumn("_base", F.floor("_exact"))
        .withColumn("_rest", F.col("_exact") - F.col("_base"))
        .withColumn("_left", F.col("_test") - F.sum("_base").over(everything))
        .withColumn("_extra", (F.row_number().over(by_remainder) <= F.col("_left")).cast("bigint"))
        .select(label, (F.col("_base") + F.col("_extra")).alias("quota"))
    )


def expand_copies(df: DataFrame, copies: str, chunk: int = 100_000) -> DataFrame:
    """Repeat each row ``copies`` times; large counts are dealt out in chunks first."""
    chunks = F.sequence(F.lit(0), F.ceil(F.col(copies) / chunk) - 1)
    dealt = df.withColumn("_chunk", F.explode(chunks)).repartition("_chunk", *df.columns)
    size = F.least(F.lit(chunk), F.col(copies) - F.col("_chunk") * chunk)
    return dealt.withColumn("_copy", F.explode(F.sequence(F.lit(1), size.cast("int")))).drop(
        "_chunk", "_copy", copies
    )


def train_test_split(
    df: DataFrame, label: str = TARGET, test_size: float = 0.25, seed: int = 42
) -> DataFrame:
    """Add ``split`` ('train' / 'test') with exact, stratified sizes.

    Rows are ordered by a hash of their content. Its leading bits give 2^12 buckets
    per class; bucket counts locate the one bucket where the class quota is met. Rows
    in other buckets are settled by comparison alone, and only that bucket is ranked.
    There, equal rows are ranked as one counted row, so copies cannot flood a task.
    Rows without a label are a class like any other.
    """
    columns = list(df.columns)
    hashed = df.withColumn("_hash", row_order(df, seed)).withColumn(
        "_bucket", F.shiftrightunsigned("_hash", 64 - _BUCKET_BITS)
    )
    counts = hashed.groupBy(label, "_bucket").agg(F.count("*").alias("n"))
    sizes = counts.groupBy(label).agg(F.sum("n").alias("size"))
    quota = class_quota(sizes, label, test_size).withColumnRenamed(label, "_quota_class")
    upto = Window.partitionBy(label).orderBy("_bucket")
    cut = (
        counts.withColumn("upto", F.sum("n").over(upto))
        .join(quota, F.col(label).eqNullSafe(F.col("_quota_class")))
        .where((F.col("upto") >= F.col("quota")) & (F.col("upto") - F.col("n") < F.col("quota")))
        .select(
            F.col(label).alias("_class"),
            F.col("_bucket").alias("_cut"),
            (F.col("quota") - (F.col("upto") - F.col("n"))).alias("_need"),
        )
    )
    # One row per class.
    placed = hashed.join(F.broadcast(cut), F.col(label).eqNullSafe(F.col("_class")), "left")
    settled = placed.where(F.col("_cut").isNull() | (F.col("_bucket") != F.col("_cut"))).select(
        *columns, F.when(F.col("_bucket") < F.col("_cut"), "test").otherwise("train").alias("split")
    )
    ranked = Window.partitionBy(label).orderBy("_hash", *[c for c in columns if c != label])
    before = F.sum("copies").over(ranked) - F.col("copies")
    to_test = F.greatest(F.lit(0), F.least(F.col("copies"), F.col("_need") - before))
    boundary = (
        placed.where(F.col("_bucket") == F.col("_cut"))
        .groupBy(*columns, "_hash", "_need")
        .agg(F.count("*").alias("copies"))
        .withColumn("_test", to_test)
        .select(
            *columns,
            F.inline(
                F.array(
                    F.struct(F.lit("test").alias("split"), F.col("_test").alias("_copies")),
                    F.struct(F.lit("train").alias("split"), (F.col("copies") - F.col("_test")).alias("_copies")),
                )
            ),
        )
        .where(F.col("_copies") > 0)
    )
    return settled.unionByName(expand_copies(boundary, "_copies"))
