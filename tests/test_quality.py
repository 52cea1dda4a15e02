from pyspark.sql import functions as F

from tidewatch.operators.quality import data_quality, duplicate_rows, missing_share
from tidewatch.schema import MonitorConfig, normalise_missing


def test_duplicates_missing_and_lookalikes(spark):
    rows = [
        ("b", "x", 1.0, None),
        ("b", "x", 1.0, None),  # NULL equals NULL
        ("b", "", None, 1),
        ("b", None, None, 1),  # empty text is not missing
        ("b", 'a","1":2', 0.0, 2),
        ("b", "a", -0.0, 2),
        ("b", "a", 0.0, 2),  # -0.0 equals 0.0
        ("clean", "x", 1.0, 1),
        ("clean", "y", float("nan"), 1),
    ]
    df = normalise_missing(spark.createDataFrame(rows, "batch_file_name string, t string, v double, n int"))
    got = {r.batch_file_name: r for r in data_quality(df).collect()}
    assert got["b"].duplicate_rows == 2 and got["b"].data_quality_issue_detected
    assert got["b"].missing_percentage == 5 / 21
    assert got["clean"].duplicate_rows == 0 and got["clean"].missing_percentage == 1 / 6
    exact = (
        df.groupBy("batch_file_name", "t", (F.col("v") + 0.0).alias("v"), "n")
        .count()
        .groupBy("batch_file_name")
        .agg(F.sum(F.col("count") - 1).alias("d"))
    )
    assert {r.batch_file_name: r.duplicate_rows for r in duplicate_rows(df).collect()} == {
        r.batch_file_name: r.d for r in exact.collect()
    }
    assert {r.batch_file_name: r.missing_percentage for r in missing_share(df).collect()} == {
        k: r.missing_percentage for k, r in got.items()
    }


def test_missing_threshold_is_inclusive_and_hot_copies_count(spark):
    df = spark.range(1000).select(
        F.lit("b").alias("batch_file_name"),
        F.when(F.col("id") < 950, F.lit(1)).otherwise(F.lit(None)).alias("x"),
    )
    row = data_quality(df, config=MonitorConfig(missing_threshold=0.05)).first()
    assert row.missing_percentage == 0.05 and row.duplicate_rows == 998
    row = data_quality(df.withColumn("id", F.monotonically_increasing_id()).drop("x")).first()
    assert row.duplicate_rows == 0 and not row.data_quality_issue_detected
