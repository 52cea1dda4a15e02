"""Arithmetic, ranking and wording against published result tables."""

from pathlib import Path

import pytest

from tidewatch.functions.text import clean_batch_name, clean_feature_name, fixed
from tidewatch.operators import attribution as att
from tidewatch.operators import reporting
from tidewatch.operators.performance import classification_metrics
from tidewatch.plans.incident import get_incident, incident_lookup, incident_prompts, incidents
from tidewatch.schema import REPORT_COLUMNS
from tidewatch.sources.outputs import load_attribution, load_incidents, load_report, save_incidents

GOLDEN = Path(__file__).parent / "golden"


@pytest.fixture(scope="module")
def report(spark):
    return load_report(spark, str(GOLDEN / "report.csv"), "csv")


@pytest.fixture(scope="module")
def comparison(spark):
    return load_attribution(spark, str(GOLDEN / "comparison.csv"), fmt="csv")


def test_report_schema(report):
    assert tuple(report.columns) == REPORT_COLUMNS
    assert [r.anomaly_detected for r in report.orderBy("batch_name").collect()] == [False, True, True, True]


def test_comparison_values_and_order(spark, comparison):
    base = load_attribution(spark, str(GOLDEN / "baseline_importance.csv"), comparison=False, fmt="csv")
    batch = load_attribution(spark, str(GOLDEN / "batch_importance.csv"), comparison=False, fmt="csv")
    got = att.rank_changes(att.compare_attribution(base, batch)).collect()
    lines = (GOLDEN / "comparison.csv").read_text().splitlines()[1:]
    assert [r.feature for r in got] == [line.split(",")[0] for line in lines]
    for row, line in zip(got, lines):
        assert row.shap_impact_change == pytest.approx(float(line.split(",")[3]), abs=1e-7)
    assert [r.feature for r in att.rank_importance(base).limit(2).collect()] == [
        "merchant_risk_score",
        "country_IN",
    ]


def test_incident_texts_match_to_the_byte(spark, report, comparison, tmp_path):
    rows = incidents(report, comparison)
    got = {r.batch_name: r for r in rows.collect()}
    assert set(got) == {
        "batch_02_feature_drift.csv",
        "batch_03_prediction_drift.csv",
        "batch_04_quality_issue.csv",
    }
    for name, row in got.items():
        assert row.severity == "High"
        assert row.summary == (GOLDEN / name.replace(".csv", ".txt")).read_text()
    save_incidents(rows, str(tmp_path / "incidents"))
    stored = {r.incident: r.value for r in load_incidents(spark, str(tmp_path / "incidents")).collect()}
    assert stored["batch_02_feature_drift_incident_summary.txt"].rstrip("\n") == got[
        "batch_02_feature_drift.csv"
    ].summary
    looked_up = {r.batch_name: r.summary for r in incident_lookup(report, comparison).collect()}
    assert looked_up["batch_01_normal.csv"] is None
    assert get_incident(rows, "batch_03_prediction_drift.csv").count() == 1
    assert get_incident(rows, "batch_01_normal.csv").count() == 0


def test_no_anomaly_no_incident(report, comparison):
    assert incidents(report.where("NOT anomaly_detected"), comparison).count() == 0


def test_prompt(report, comparison):
    prompt = incident_prompts(report, comparison).where("batch_name LIKE 'batch_04%'").first().prompt
    assert "- Rows: 2050\n- Actual fraud rate: 0.0385\n" in prompt
    assert "- Prediction drift detected: False\n" in prompt and "- Duplicate rows: 50\n" in prompt
    assert "\n         login_velocity_24h                0.235163" in prompt


def test_metrics_from_counts(spark, report):
    counts = spark.createDataFrame(
        [
            ("batch_01_normal.csv", 13, 641, 19, 1327),
            ("batch_02_feature_drift.csv", 66, 1033, 39, 862),
            ("batch_03_prediction_drift.csv", 58, 853, 41, 1048),
            ("batch_04_quality_issue.csv", 33, 801, 46, 1170),
        ],
        "batch_name string, tp long, fp long, fn long, tn long",
    )
    expected = {r.batch_name: r for r in report.collect()}
    for row in classification_metrics(counts).collect():
        for metric in ("accuracy", "precision", "recall", "f1_score"):
            assert row[metric] == pytest.approx(expected[row.batch_name][metric], abs=1e-12)


def test_report_views(spark, report):
    overview = reporting.overview(report).first()
    assert tuple(overview) == (4, 1, 3, 0.418)
    assert reporting.risk_long(report).count() == 8 and reporting.performance_long(report).count() == 20
    flags = {r.batch_name: r.data_quality_issue_detected for r in reporting.format_flags(report).collect()}
    assert flags["batch_04_quality_issue.csv"] == "Detected" and flags["batch_01_normal.csv"] == "Not Detected"
    assert reporting.batch_row(report, "batch_01_normal.csv").count() == 1
    status = {r.batch_name: r.status for r in reporting.status(report).collect()}
    assert status["batch_01_normal.csv"] == "Normal Batch"
    kpi = {r.batch_name: r.missing_value_percent for r in reporting.kpi_cards(report).collect()}
    assert kpi["batch_04_quality_issue.csv"] == 0.48


def test_severity_by_flag_count(spark):
    rows = [(a, b, c) for a in (True, False, None) for b in (True, False) for c in (True, False)]
    df = spark.createDataFrame(
        rows,
        "prediction_drift_detected boolean, feature_drift_detected boolean, data_quality_issue_detected boolean",
    )
    for r in reporting.assign_severity(df).collect():
        raised = sum(bool(x) for x in r[:3])
        assert r.severity == ("Low", "Medium", "High", "High")[raised]


def test_text_functions(spark):
    row = (
        spark.createDataFrame([("a.csv.csv", "cat__num__x", 0.12345)], "b string, f string, v double")
        .select(clean_batch_name("b"), clean_feature_name("f"), fixed("v"))
        .first()
    )
    assert tuple(row) == ("a", "x", "0.1235")
