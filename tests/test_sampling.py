import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewatch.operators.sampling import expand_copies, sample_n, sample_per_key, train_test_split


def test_split_is_exact_whole_and_repeatable_with_hot_copies(spark):
    rows = [(i, f"u{i}", int(i % 7 == 0)) for i in range(600)] + [(-1, "hot", 0)] * 400
    df = spark.createDataFrame(rows, "id long, name string, label_fraud int")
    sizes = Counter(r[2] for r in rows)
    got = train_test_split(df).collect()
    assert Counter((r.id, r.name, r.label_fraud) for r in got) == Counter(rows)
    test = Counter(r.label_fraud for r in got if r.split == "test")
    assert sum(test.values()) == math.ceil(0.25 * len(rows))
    for label, size in sizes.items():
        assert abs(test[label] - size / 4) < 1
    again = train_test_split(df.repartition(3)).collect()
    assert Counter(again) == Counter(got)
    other = train_test_split(df, seed=1).collect()
    assert Counter(other) != Counter(got)


def test_split_cuts_through_a_group_of_copies(spark):
    df = spark.createDataFrame([("same", 1)] * 10 + [("same", 0)] * 30, "name string, label_fraud int")
    got = Counter((r.label_fraud, r.split) for r in train_test_split(df).collect())
    assert sum(n for (_, split), n in got.items() if split == "test") == 10
    assert got[1, "test"] + got[1, "train"] == 10 and got[0, "test"] + got[0, "train"] == 30
    assert got[1, "test"] in (2, 3)


@pytest.mark.parametrize("chunk", [1, 4, 100])
def test_expand_copies(spark, chunk):
    df = spark.createDataFrame([("a", 1), ("b", 9), ("c", 4)], "k string, n long")
    got = Counter(r.k for r in expand_copies(df, "n", chunk).collect())
    assert got == {"a": 1, "b": 9, "c": 4}


def test_samples(spark):
    df = spark.range(1000).select("id", (F.col("id") < 30).alias("small"))
    picked = {r.id for r in sample_n(df, 50).collect()}
    assert len(picked) == 50
    assert picked == {r.id for r in sample_n(df.repartition(5), 50).collect()}
    assert picked != {r.id for r in sample_n(df, 50, seed=7).collect()}
    assert sample_n(df, 5000).count() == 1000
    by_key = sample_per_key(df, ["small"], 40)
    assert {r.small: r["count"] for r in by_key.groupBy("small").count().collect()} == {True: 30, False: 40}
    plan = by_key._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_rows_of_a_key_do_not_meet_before_they_are_chosen(spark):
    df = spark.range(1000).select("id", (F.col("id") < 30).alias("small"))
    plan = sample_per_key(df, ["small"], 40)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = sample_per_key(df, ["small"], 40)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan
