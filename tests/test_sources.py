import pytest
from pyspark.sql import functions as F

from tidewatch.catalog.view import transactions
from tidewatch.operators.quality import original_columns
from tidewatch.operators.validation import high_risk
from tidewatch.schema import DROP_COLUMNS, TEXT_TYPES, column_roles, require_columns
from tidewatch.session import shared_folder
from tidewatch.sources import outputs
from tidewatch.sources.transactions import (
    describe_inputs,
    header_catalogue,
    load_baseline,
    load_batch,
    load_batches,
    load_snapshot,
    load_transactions,
    save_snapshot,
    save_transactions,
    save_transactions_at,
    union_sources,
)

HEADER = "transaction_id,amount,transaction_hour,channel,label_fraud\n"


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "b1.csv").write_text(HEADER + "t1,1.5,3,web,1\nt2,NaN,4.0,NA,0\nt3,,5,,0\nt4,NA,6,null,1\n")
    (tmp_path / "b2.csv").write_text(HEADER + "t5,2,7,pos,0\n")
    (tmp_path / "notes.txt").write_text("not a batch")
    return tmp_path


def test_missing_tokens_and_integral_text(spark, folder):
    rows = {r.transaction_id: r for r in load_batches(spark, str(folder)).collect()}
    assert len(rows) == 5
    assert [rows[t].amount for t in ("t1", "t2", "t3", "t4", "t5")] == [1.5, None, None, None, 2.0]
    assert rows["t2"].transaction_hour == 4.0  # written as 4.0 beside a gap
    assert [rows[t].channel for t in ("t1", "t2", "t3", "t4")] == ["web", None, None, None]
    assert {r.batch_file_name for r in rows.values()} == {"b1.csv", "b2.csv"}
    assert rows["t1"].label_fraud == 1


def test_one_batch_and_shapes(spark, folder):
    assert load_batch(spark, str(folder), "b2.csv").count() == 1
    assert load_baseline(spark, str(folder / "b1.csv")).count() == 4
    shapes = {r.batch_file_name: (r.rows, r.columns) for r in describe_inputs(load_batches(spark, str(folder))).collect()}
    assert shapes == {"b1.csv": (4, 5), "b2.csv": (1, 5)}


def test_columns_are_matched_by_name(spark, folder):
    (folder / "b3.csv").write_text("amount,label_fraud,transaction_id\n9,1,t9\n")
    with pytest.raises(Exception, match="(?i)header"):
        load_batches(spark, str(folder)).collect()
    rows = {r.transaction_id: r for r in load_batches(spark, str(folder), same_header=False).collect()}
    assert len(rows) == 6 and rows["t9"].amount == 9.0 and rows["t9"].channel is None


def test_text_as_it_is_written(spark, tmp_path):
    """Doubled quotes, names with blanks and signs, folders below, damaged cells and lines."""
    (tmp_path / "my batch.csv").write_text(HEADER + 't1,1.5,3,"a ""b"", c",1\n')
    (tmp_path / "x=y+z%41.csv").write_text(HEADER + "t2,2,4,web,0\n")
    (tmp_path / "archive").mkdir()
    (tmp_path / "archive" / "old.csv").write_text(HEADER + "t3,1,1,web,0\n")
    rows = {r.transaction_id: r for r in load_batches(spark, str(tmp_path)).collect()}
    assert set(rows) == {"t1", "t2"}
    assert rows["t1"].channel == 'a "b", c' and rows["t1"].label_fraud == 1
    assert [rows[t].batch_file_name for t in ("t1", "t2")] == ["my batch.csv", "x=y+z%41.csv"]
    (tmp_path / "broken.csv").write_text(HEADER + 't4,1,2,"two\nlines",0\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        load_batches(spark, str(tmp_path)).collect()
    read = load_batches(spark, str(tmp_path), multi_line=True).where("transaction_id = 't4'").collect()
    assert [r.channel for r in read] == ["two\nlines"]
    (tmp_path / "broken.csv").write_text(HEADER + "t5,abc,2,web,0\n")
    with pytest.raises(Exception, match="not a number in amount: abc"):
        load_batches(spark, str(tmp_path)).collect()


def test_union_keeps_duplicates_and_fills_absent_columns(spark, folder):
    batches = load_batches(spark, str(folder))
    both = union_sources(load_baseline(spark, str(folder / "b1.csv")), batches.drop("amount"))
    assert both.count() == 9
    assert both.where(F.col("data_source") == "production_batch").where("amount IS NOT NULL").count() == 0


def test_table_round_trip_prunes_partitions(spark, sf_dir, tmp_path):
    txn = transactions(spark, sf_dir)
    save_transactions_at(txn, str(tmp_path / "txn"))
    stored = load_transactions(spark, str(tmp_path / "txn"))
    assert set(stored.columns) == set(txn.columns)
    one = stored.where(F.col("batch_file_name") == "batch_05_recent.csv")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch_file_name" in plan
    filtered = high_risk(stored)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(fraud_probability_simulated,0.3)" in filtered
    save_transactions(one, "kept_transactions")
    save_transactions(one, "kept_transactions")
    assert spark.table("kept_transactions").count() == one.count()


def test_roles_and_required_columns(spark, sf_dir):
    txn = transactions(spark, sf_dir)
    categorical, numeric = column_roles(txn)
    assert categorical == ["channel", "country", "merchant_category", "payment_method"]
    assert len(numeric) == 8 and len(original_columns(txn)) == 19 == len(TEXT_TYPES)
    with pytest.raises(ValueError, match="nope"):
        require_columns(txn, [*DROP_COLUMNS, "nope"])


def test_a_run_written_twice_is_one_run(spark, tmp_path):
    path = str(tmp_path / "log")
    report = spark.createDataFrame([("b.csv", 3, 0.5)], "batch_name string, rows long, accuracy double")
    log = lambda rows, run: outputs.log_metrics(rows, path, run, params=("rows",), metrics=("accuracy",))
    log(report, "r1")
    log(report, "r1")
    expected = [("metric", "accuracy", None, 0.5), ("param", "rows", "3", None)]
    facts = lambda df: [(r.kind, r.key, r.text_value, r.value) for r in df.orderBy("kind").collect()]
    assert facts(outputs.load_log(spark, path)) == expected
    log(report.withColumn("rows", F.lit(4)), "r2")
    log(report, None)
    log(report.withColumn("batch_name", F.lit("c.csv")), "r1b")
    assert outputs.load_log(spark, path).count() == 8
    newest = outputs.latest_runs(outputs.load_log(spark, path))
    assert facts(newest.where("run_name = 'b.csv'")) == expected and newest.count() == 4


def test_each_batch_has_its_own_columns(spark, folder):
    (folder / "b3.csv").mkdir()
    (folder / "b3.csv" / "part-0.csv").write_text('amount,"label_fraud",transaction_id\n9,1,t9\n')
    (folder / "b3.csv" / "part-1.csv").write_text("transaction_id,amount\nt10,1\n")
    catalogue = header_catalogue(spark, str(folder))
    assert {(r.batch_file_name, r.position, r.column_name) for r in catalogue.collect()} >= {("b3.csv", 1, "label_fraud"), ("b1.csv", 3, "channel")}
    batches = load_batches(spark, str(folder), same_header=False)
    shapes = {r.batch_file_name: (r.rows, r.columns) for r in describe_inputs(batches, catalogue=catalogue).collect()}
    assert shapes == {"b1.csv": (4, 5), "b2.csv": (1, 5), "b3.csv": (2, 3)}


def test_a_failed_write_leaves_the_former_version(spark, folder, tmp_path):
    root, rows = str(tmp_path / "versions"), load_batches(spark, str(folder))
    with pytest.raises(FileNotFoundError):
        load_snapshot(spark, root)
    first = save_snapshot(rows.where("transaction_id = 't1'"), root)
    former = load_snapshot(spark, root)
    broken = rows.withColumn("amount", F.when(F.col("transaction_id") == "t5", F.raise_error(F.lit("no"))).otherwise(F.col("amount")))
    with pytest.raises(Exception, match="no"):
        save_snapshot(broken, root)
    assert load_snapshot(spark, root).count() == 1
    save_snapshot(rows, root)
    assert load_snapshot(spark, root).count() == 5 and former.count() == 1  # read and written at the same time
    assert load_snapshot(spark, root, first).count() == 1
    save_snapshot(rows, root, keep=1)
    assert len(list((tmp_path / "versions").glob("version=*"))) == 2  # the newest, and the one that failed


def test_confusion_is_written_with_named_cells(spark, tmp_path):
    counts = spark.createDataFrame([(1, 2, 3, 4)], "tp long, fp long, fn long, tn long")
    outputs.save_confusion(counts, str(tmp_path / "cm"))
    rows = spark.read.option("header", True).csv(str(tmp_path / "cm")).orderBy("actual").collect()
    assert [tuple(r) for r in rows] == [("Actual_0", "4", "2"), ("Actual_1", "3", "1")]


def test_session_settings(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
