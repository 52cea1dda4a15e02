"""Distribution distance and ROC-AUC against brute force, with one and several value ranges."""

import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import ordered
from tidewatch.operators.drift import feature_drift, feature_drift_flag, histogram_drift, prediction_drift, value_histogram
from tidewatch.operators.performance import classification_metrics, roc_auc, score_performance
from tidewatch.schema import MonitorConfig


def brute_ks(base, batch):
    base = [v for v in base if v is not None]
    batch = [v for v in batch if v is not None]
    if not base or not batch:
        return 0.0
    share = lambda sample, v: sum(x <= v for x in sample) / len(sample)
    return max(abs(share(base, v) - share(batch, v)) for v in {*base, *batch})


def brute_auc(rows):
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    if not pos or not neg:
        return None
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.fixture(scope="module")
def samples():
    rng = random.Random(7)
    draw = {
        "normal": lambda: rng.gauss(0, 1),
        "shifted": lambda: rng.gauss(2, 1),
        "tied": lambda: float(rng.randint(0, 3)),
        "gaps": lambda: rng.choice([None, rng.gauss(0, 1), -0.0, 0.0]),
        "missing": lambda: None,
        "disjoint": lambda: rng.uniform(50, 60),
        "one_value": lambda: 1.0,
    }
    sizes = {"train.csv": 80, "a.csv": 60, "b.csv": 5, "c.csv": 1}
    features = {
        # feature: (baseline draw, batch draw)
        "same": ("normal", "normal"),
        "moved": ("normal", "shifted"),
        "ties": ("tied", "tied"),
        "gappy": ("gaps", "gaps"),
        "base_missing": ("missing", "normal"),
        "batch_missing": ("normal", "missing"),
        "far": ("normal", "disjoint"),
        "constant": ("one_value", "one_value"),
    }
    data = {
        name: {f: [draw[pair[name != "train.csv"]]() for _ in range(size)] for f, pair in features.items()}
        for name, size in sizes.items()
    }
    return list(features), data


@pytest.mark.parametrize("buckets", [1, 5, 16])
def test_ks_equals_brute_force(spark, samples, buckets):
    features, data = samples
    rows = [
        (name, "baseline" if name == "train.csv" else "production_batch", *values)
        for name, columns in data.items()
        for values in zip(*columns.values())
    ]
    schema = "batch_file_name string, data_source string, " + ", ".join(f"`{f}` double" for f in features)
    txn = spark.createDataFrame(rows, schema)
    got = {(r.batch_name, r.feature): r.ks for r in feature_drift(txn, features, buckets=buckets).collect()}
    expected = {
        (name, f): brute_ks(data["train.csv"][f], columns[f])
        for name, columns in data.items()
        if name != "train.csv"
        for f in features
    }
    assert got.keys() == expected.keys()
    for key, value in expected.items():
        assert got[key] == pytest.approx(value, abs=1e-12), key
    assert got["a.csv", "far"] == 1.0 and got["a.csv", "constant"] == 0.0


@pytest.mark.parametrize("buckets", [1, 6])
def test_auc_equals_brute_force(spark, buckets):
    rng = random.Random(11)
    batches = {
        "mixed": [(rng.random(), rng.randint(0, 1)) for _ in range(70)],
        "tied": [(float(rng.randint(0, 2)), rng.randint(0, 1)) for _ in range(50)],
        "one_class": [(rng.random(), 0) for _ in range(9)],
        "perfect": [(0.1, 0), (0.2, 0), (0.8, 1)],
    }
    rows = [(b, s, y) for b, pairs in batches.items() for s, y in pairs]
    rows += [("mixed", None, 1), ("mixed", 0.5, None)]  # neither counts in the metrics
    df = spark.createDataFrame(rows, "batch_file_name string, score double, label_fraud int")
    got = {r.batch_file_name: r.roc_auc for r in roc_auc(df, buckets=buckets).collect()}
    for name, pairs in batches.items():
        expected = brute_auc(pairs)
        assert got[name] == (None if expected is None else pytest.approx(expected, abs=1e-12))


def test_score_performance_counts_inclusive_threshold(spark):
    df = spark.createDataFrame(
        [("b", 0.30, 1), ("b", 0.2999, 1), ("b", 0.30, 0), ("b", 0.1, 0), ("none", 0.1, 1)],
        "k string, score double, label_fraud int",
    )
    got = {r.k: r for r in classification_metrics(score_performance(df, ["k"], "score")).collect()}
    assert (got["b"].tp, got["b"].fp, got["b"].fn, got["b"].tn) == (1, 1, 1, 1)
    assert got["b"].accuracy == got["b"].precision == got["b"].recall == got["b"].f1_score == 0.5
    assert (got["none"].precision, got["none"].recall, got["none"].f1_score) == (0.0, 0.0, 0.0)


def test_flags_are_inclusive_and_ties_take_the_first_column(spark):
    drift = spark.createDataFrame(
        [("x", "b", 0.15), ("x", "a", 0.15), ("y", "a", 0.0), ("y", "b", 0.0)],
        "batch_name string, feature string, ks double",
    )
    got = {r.batch_name: r for r in feature_drift_flag(drift, ["b", "a"]).collect()}
    assert got["x"].most_drifted_feature == "b" and got["x"].feature_drift_detected
    assert got["y"].most_drifted_feature == "b" and not got["y"].feature_drift_detected

    by_batch = spark.createDataFrame(
        [("base", True, 0.25), ("at", False, 0.5), ("below", False, 0.375)],
        "batch_name string, is_baseline boolean, avg_predicted_risk double",
    )
    rows = prediction_drift(by_batch, MonitorConfig(prediction_drift_threshold=0.25)).collect()
    assert {r.batch_name: r.prediction_drift_detected for r in rows} == {"at": True, "below": False}


def test_ranges_read_the_table_once_and_never_sort_a_series_in_one_task(spark, sf_dir, tmp_path):
    path = str(tmp_path / "txn")
    spark.range(200).select(
        F.concat(F.lit("b"), F.col("id") % 3).alias("batch_file_name"),
        F.when(F.col("id") % 3 == 0, "baseline").otherwise("production_batch").alias("data_source"),
        F.rand(1).alias("x"),
        F.rand(2).alias("y"),
    ).write.parquet(path)
    df = feature_drift(spark.read.parquet(path), buckets=4)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("FileScan parquet") == 1
    assert "ReusedExchange" in final and "CartesianProduct" not in final


def test_the_tree_follows_the_rows():
    assert ordered.shape(0) == ordered.shape(10, 10) == () and ordered.shape(11, 10) == (2,)
    assert ordered.shape(95, 10, 10) == (10,) and ordered.shape(105, 10, 10) == (4, 4)
    for rows in (10**3, 10**5, 10**7):
        widths = ordered.shape(rows, 10, 20)
        ranges = 1
        for w in widths:
            assert w <= 20
            ranges *= w
        assert ranges * 10 >= rows


@pytest.mark.parametrize("limit, width", [(7, 3), (20, 2)])
def test_a_deep_tree_gives_what_one_range_gives(spark, samples, monkeypatch, limit, width):
    monkeypatch.setattr(ordered, "LIMIT", limit)
    monkeypatch.setattr(ordered, "WIDTH", width)
    features, data = samples
    rows = [
        (name, "baseline" if name == "train.csv" else "production_batch", i, *values)
        for name, columns in data.items()
        for i, values in enumerate(zip(*columns.values()))
    ]
    schema = "batch_file_name string, data_source string, label_fraud int, " + ", ".join(f"`{f}` double" for f in features)
    txn = spark.createDataFrame([(a, b, i % 2, *v) for a, b, i, *v in rows], schema)
    one = {(r.batch_name, r.feature): r.ks for r in feature_drift(txn, features, buckets=1).collect()}
    many = {(r.batch_name, r.feature): r.ks for r in feature_drift(txn, features).collect()}
    assert many == pytest.approx(one, abs=1e-12)
    alone = {r.batch_file_name: r.roc_auc for r in roc_auc(txn, score="moved", buckets=1).collect()}
    assert {r.batch_file_name: r.roc_auc for r in roc_auc(txn, score="moved").collect()} == pytest.approx(alone, abs=1e-12)


def test_a_million_values_never_meet_in_one_task(spark, monkeypatch):
    """Eight shuffle partitions, one series: the rows of the largest range stay about at the limit."""
    monkeypatch.setattr(ordered, "LIMIT", 20_000)
    monkeypatch.setattr(ordered, "WIDTH", 8)
    txn = spark.range(1_000_000).select(
        F.when(F.col("id") % 2 == 0, "train.csv").otherwise("a.csv").alias("batch_file_name"),
        F.when(F.col("id") % 2 == 0, "baseline").otherwise("production_batch").alias("data_source"),
        (F.rand(3) * F.rand(4) + (F.col("id") % 2) / 50).alias("x"),
    )
    hist, widths = ordered.sized(value_histogram(txn, ["x"]), "feature", None)
    assert len(widths) == 2 and widths[0] <= 8
    sizes = ordered.with_buckets(hist, "feature", "value", widths).groupBy(ordered.BUCKET).count()
    assert sizes.agg(F.max("count")).first()[0] <= 1.5 * ordered.LIMIT and sizes.count() >= 50
    (many,) = histogram_drift(hist, ["x"]).collect()
    (one,) = histogram_drift(hist, ["x"], buckets=1).collect()
    assert many.ks == pytest.approx(one.ks, abs=1e-12)
