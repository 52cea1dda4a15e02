"""The category dictionary against sorting in Python."""

import random

from pyspark.sql import functions as F

from tidewatch.operators.dictionary import category_counts, encode, fit_dictionary, slot_counts, slots


def test_numbers_are_dense_and_in_order(spark):
    random.seed(1)
    rows = [(random.choice(["b", "a", "", None, "é", "Z"]), random.randint(0, 40), i % 3) for i in range(500)]
    df = spark.createDataFrame(rows, "c string, d int, k int")
    found = {(r.column_name, r.value): r.number for r in fit_dictionary(df, ["c", "d"]).collect()}
    c = sorted({r[0] for r in rows} - {None})
    d = sorted({str(r[1]) for r in rows})
    assert found == {("c", v): i for i, v in enumerate(c)} | {("d", v): i for i, v in enumerate(d)}
    named = {r.slot: r.feature for r in slots(fit_dictionary(df, ["c", "d"]), ["d", "c"]).collect()}
    assert named == dict(enumerate([f"d_{v}" for v in d] + [f"c_{v}" for v in c]))
    coded = encode(df, fit_dictionary(df.where("d > 3"), ["c", "d"]), ["c", "d"])
    assert coded.count() == 500 and coded.where("d <= 3 AND d_index IS NOT NULL").count() == 0
    counts = {(r.k, r.column_name, r.value): r.n for r in category_counts(df, ["c"], ["k"]).collect()}
    assert sum(counts.values()) == sum(r[0] is not None for r in rows)


def test_many_values_over_many_partitions(spark):
    """Two hundred thousand values, one of which a third of all rows hold."""
    df = spark.range(300_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), "id")).alias("c"))
    found = fit_dictionary(df.repartition(16), ["c"])
    row = found.agg(F.count("*").alias("n"), F.min("number").alias("low"), F.max("number").alias("high"), F.count_distinct("number").alias("d")).first()
    assert (row.n, row.low, row.high, row.d) == (200_001, 0, 200_000, 200_001)
    ordered = found.selectExpr("number", "value", "lead(value) OVER (ORDER BY number) AS next")
    assert ordered.where("next <= value").count() == 0
    assert slot_counts(df, found, ["c"], []).where("feature = 'c_hot'").first().total_rows == 100_000


def test_nothing_to_number(spark):
    df = spark.createDataFrame([(None,)], "c string")
    assert fit_dictionary(df, ["c"]).count() == 0 and fit_dictionary(df.limit(0), ["c"]).count() == 0
    assert encode(df, fit_dictionary(df, ["c"]), ["c"]).first().c_index is None
