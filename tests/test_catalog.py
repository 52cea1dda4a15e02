"""Registered queries against their SQL counterparts at the smallest scale."""

import math

import duckdb
import pytest

import __spark_entry__ as driver
from tidewatch.catalog.queries import joined_once
from tidewatch.schema import REPORT_COLUMNS

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
# One query per operator family; the views of the report share its plan and are left out here.
CHECKED = """load_batch load_all_batches batch_shapes transactions_table report_roundtrip transactions
union_sources feature_projection scored volume_by_source risk_profile missing_by_batch high_risk_by_batch
validation_sql data_quality missing_share confusion_table classification_metrics roc_auc roc_auc_ranges
class_balance feature_drift feature_drift_ranges feature_drift_flag prediction_drift event_value_drift
document_duplicates label_performance linear_attribution attribution_rank attribution_compare top_changes
top_changes_text incidents incident_prompt sample_sizes split_sizes split_rows one_hot
category_dictionary mixed_headers mixed_shapes column_listing snapshot_table run_log sample_total batch_incidents split_histogram
root_split monitoring_report profile_report stream_report mean_abs_attribution overview severity kpi_cards
load_baseline feature_label column_roles encoded_features train_facts model_roundtrip shap_columns_additivity""".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(frame):
    def cell(v):
        missing = v is None or (isinstance(v, float) and math.isnan(v))
        return "NULL" if missing else repr(v) if isinstance(v, float) else str(v)

    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(cell, row)) for row in frame[columns].itertuples(index=False))


def test_every_sql_belongs_to_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert set(CHECKED) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, sf_dir, duck, name):
    got = driver.queries()[name](spark, sf_dir).toPandas()
    assert canonical(got) == canonical(duck.sql(driver.oracle_sql()[name]).df())


def test_entry(spark):
    report = driver.entry(spark)
    assert tuple(report.columns) == REPORT_COLUMNS and report.count() == 5


def test_the_joined_table_is_written_small(spark, sf_dir):
    """It is the largest table that a report leaves on disk."""
    files = joined_once(spark, sf_dir).inputFiles()
    assert files and all(f.endswith(".zstd.parquet") for f in files)
