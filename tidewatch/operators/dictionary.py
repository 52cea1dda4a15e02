"""Numbers for category values, found and looked up by Spark however many values there are.

The different values of all columns are sorted over range partitions. A value's number is its place in its
partition plus the values of its column in the partitions before, which are one count per partition and column.
Nothing but these counts is ever in one task, and nothing goes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.schema import require_columns
from tidewatch.session import run_folder


def category_counts(df: DataFrame, columns: list[str], keys: list[str] = ()) -> DataFrame:
    """Rows per (keys, column_name, value): one row per value that occurs, combined map-side. NULLs are left out."""
    require_columns(df, [*columns, *keys])
    entries = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(*keys, F.inline(entries)).where("value IS NOT NULL").groupBy(*keys, "column_name", "value").agg(F.count("*").alias("n"))


def fit_dictionary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value, number): numbers from 0 without gaps in each column, in the order of its values.

    Columns count as text, NULL is no value, and an empty text is one. The values are written to the shared folder
    once, as places in a partition must not change between two readings.
    """
    spark = df.sparkSession
    path = run_folder(spark, "dictionary")
    values = category_counts(df, columns).select("column_name", "value")
    ordered = values.repartitionByRange("column_name", "value").sortWithinPartitions("column_name", "value")
    ordered.select("*", F.monotonically_increasing_id().alias("place")).write.parquet(path)
    stored = spark.read.schema("column_name string, value string, place long").parquet(path)
    part = F.shiftright("place", 33)
    counts = stored.groupBy("column_name", part.alias("part")).agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = Window.partitionBy("column_name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(
        F.col("column_name").alias("_column"), F.col("part").alias("_part"), "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    same = (F.col("column_name") == F.col("_column")) & (part == F.col("_part"))
    return stored.join(bases, same).select("column_name", "value", (F.col("base") + F.col("place") - F.col("first")).alias("number"))


def slots(dictionary: DataFrame, columns: list[str]) -> DataFrame:
    """With ``slot``, the position in the one-hot block of these columns one after the other, and ``feature``, its name.

    The offsets are one row per column.
    """
    order = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("column_name"))
    sizes = dictionary.groupBy("column_name").agg(F.count("*").alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("column_name").alias("_column"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return dictionary.join(F.broadcast(offsets), F.col("column_name") == F.col("_column")).select(
        "column_name", "value", "number", (F.col("offset") + F.col("number")).alias("slot"), F.concat_ws("_", "column_name", "value").alias("feature")
    )


def encode(df: DataFrame, dictionary: DataFrame, columns: list[str]) -> DataFrame:
    """With ``<column>_index`` for each column: the value's number, NULL if it is missing or unseen.

    One join per column; whether the values are broadcast is decided by their size at run time.
    """
    for c in columns:
        own = dictionary.where(F.col("column_name") == c).select(F.col("value").alias("_value"), F.col("number").alias(f"{c}_index"))
        df = df.join(own, F.col(c).cast("string") == F.col("_value"), "left").drop("_value")
    return df


def slot_counts(df: DataFrame, dictionary: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Rows per (keys, one-hot feature). Counts come first, so only different values meet the dictionary."""
    counts = category_counts(df, columns, keys)
    named = slots(dictionary, columns).select(F.col("column_name").alias("_column"), F.col("value").alias("_value"), "feature")
    found = counts.join(named, (F.col("column_name") == F.col("_column")) & (F.col("value") == F.col("_value")))
    return found.select(*keys, "feature", F.col("n").alias("total_rows"))
