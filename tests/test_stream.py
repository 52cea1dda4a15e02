import pytest
from pyspark.sql import functions as F

from tidewatch.catalog.view import transactions
from tidewatch.operators.drift import numeric_features
from tidewatch.plans.monitor import load_profile, monitor, save_profile
from tidewatch.schema import BATCH_COLUMN, TAG_COLUMNS
from tidewatch.streaming.monitor_stream import BatchCounts, counts_of, monitor_stream, read_batches, read_text_batches


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_stream_reports_each_batch_once_and_like_the_batch_plan(spark, sf_dir, tmp_path, fmt):
    txn = transactions(spark, sf_dir)
    columns = [c for c in txn.columns if c not in TAG_COLUMNS]
    arriving = tmp_path / "arriving"
    arriving.mkdir()
    names = ("batch_01_normal", "batch_04_quality_issue")

    def arrive(name):
        folder = str(tmp_path / f"{name}-parts")
        txn.where(F.col(BATCH_COLUMN) == f"{name}.csv").select(*columns).coalesce(1).write.format(
            fmt
        ).option("header", True).save(folder)
        (part,) = (tmp_path / f"{name}-parts").glob(f"*.{fmt}")
        (arriving / f"{name}.{fmt}").write_bytes(part.read_bytes())

    scorer = lambda df: df.withColumn("score", F.col("fraud_probability_simulated"))
    features = numeric_features(txn)
    save_profile(scorer(txn.where("data_source = 'baseline'")), "score", features, str(tmp_path / "profile"))
    profile = load_profile(spark, str(tmp_path / "profile"), features)
    schema = txn.select(*columns).schema

    def run():
        if fmt == "csv":
            batches = read_text_batches(spark, str(arriving), columns)
        else:
            batches = read_batches(spark, str(arriving), schema)
        writer = monitor_stream(
            batches, profile, scorer, str(tmp_path / "report"), str(tmp_path / "state"), "score"
        )
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()

    for name in names:
        arrive(name)
        run()
    run()  # nothing new
    got = spark.read.parquet(str(tmp_path / "report")).drop("epoch")
    rows = {r.batch_name.split(".")[0]: r for r in got.collect()}
    assert set(rows) == set(names) and got.count() == 2
    expected = {
        r.batch_name.split(".")[0]: r for r in monitor(txn, "fraud_probability_simulated").collect()
    }
    for name in names:
        for column in ("rows", "duplicate_rows", "missing_percentage", "max_feature_drift_score", "roc_auc", "anomaly_detected"):
            assert rows[name][column] == expected[name][column], (name, column)
        assert abs(rows[name].prediction_drift_score - expected[name].prediction_drift_score) < 1e-12


@pytest.mark.parametrize("apart, compact_after", [(False, 8), (True, 8), (True, 1)])
def test_a_batch_in_several_micro_batches_is_reported_whole(spark, sf_dir, tmp_path, apart, compact_after):
    """Part files split by max_files, or arriving one after the other, give one row for the batch."""
    txn = transactions(spark, sf_dir)
    columns = [c for c in txn.columns if c not in TAG_COLUMNS]
    scorer = lambda df: df.withColumn("score", F.col("fraud_probability_simulated"))
    features = numeric_features(txn)
    save_profile(scorer(txn.where("data_source = 'baseline'")), "score", features, str(tmp_path / "profile"))
    profile = load_profile(spark, str(tmp_path / "profile"), features)
    name = "batch_04_quality_issue.csv"
    rows = txn.where(F.col(BATCH_COLUMN) == name).select(*columns)
    rows.repartition(3, "transaction_id").write.option("header", True).csv(str(tmp_path / "made"))
    parts = sorted((tmp_path / "made").glob("part-*.csv"))
    assert len(parts) == 3
    folder = tmp_path / "arriving" / name
    folder.mkdir(parents=True)

    def run():
        batches = read_text_batches(spark, str(tmp_path / "arriving" / "*"), columns, max_files=1)
        paths = str(tmp_path / "report"), str(tmp_path / "state")
        monitor_stream(batches, profile, scorer, *paths, "score", compact_after=compact_after).trigger(availableNow=True).start().awaitTermination()

    for part in parts:
        (folder / part.name).write_bytes(part.read_bytes())
        if apart:
            run()
    run()
    (got,) = spark.read.parquet(str(tmp_path / "report")).collect()
    (expected,) = monitor(txn, "fraud_probability_simulated").where(F.col("batch_name") == name).collect()
    for column, value in expected.asDict().items():
        assert got[column] == (pytest.approx(value, abs=1e-12) if isinstance(value, float) else value), column


def tagged(spark, rows, name="b.csv"):
    df = spark.createDataFrame(rows, "a double, b int, score double, label_fraud int")
    return df.withColumns({BATCH_COLUMN: F.lit(name), "data_source": F.lit("production_batch")})


ROWS = [(1.0, 1, 0.2, 0), (1.0, 1, 0.2, 0), (None, 2, 0.7, 1), (-0.0, None, None, 1), (0.0, 2, 0.7, None), (3.5, 1, 0.2, 0)] * 3


@pytest.mark.parametrize("cuts", [[18], [1, 1, 16], [6, 6, 6], [1] * 18])
def test_counts_add_up_however_rows_are_split(spark, tmp_path, cuts):
    columns = ["a", "b", "score", "label_fraud"]
    state, at = BatchCounts(str(tmp_path / "s"), compact_after=3), 0
    for epoch, size in enumerate(cuts):
        keys = state.add(tagged(spark, ROWS[at : at + size]), ["a", "b"], "score", columns, epoch)
        at += size
    got = state.read(spark, keys, len(cuts) - 1)
    expected = counts_of(tagged(spark, ROWS), ["a", "b"], "score", columns)
    assert got.count() == expected.count() and got.exceptAll(expected).count() == 0
    assert len(list((tmp_path / "s/parts").glob("*/*"))) <= 8


def test_a_replay_meets_what_the_first_try_met(spark, tmp_path):
    """The last micro-batch is written again, after later ones and a compaction: nothing is counted twice."""
    state, columns = BatchCounts(str(tmp_path / "s"), compact_after=2), ["a", "b", "score", "label_fraud"]
    add = lambda epoch, rows: state.add(tagged(spark, rows), ["a", "b"], "score", columns, epoch)
    for epoch in range(5):
        keys = add(epoch, ROWS[epoch : epoch + 2])
    before = sorted(map(str, state.read(spark, keys, 4).collect()))
    add(4, ROWS[4:6])
    assert sorted(map(str, state.read(spark, keys, 4).collect())) == before
    assert state.read(spark, keys, 4).where("kind = 'row'").agg(F.sum("n")).first()[0] == 10


def test_no_raw_row_is_kept(spark, tmp_path):
    state = BatchCounts(str(tmp_path / "s"))
    keys = state.add(tagged(spark, [(1.0, 1, 0.5, 1)] * 5_000), ["a", "b"], "score", ["a", "b", "score", "label_fraud"], 0)
    assert state.read(spark, keys, 0).count() == 4  # two values, one score, one digest
