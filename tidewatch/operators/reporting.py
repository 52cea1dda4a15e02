"""Views of the monitoring report: overview, long form, labels, single batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import flag_label, severity, status_label
from tidewatch.schema import REPORT_COLUMNS, REPORT_FLAGS

RISK_COLUMNS = ("avg_predicted_risk", "baseline_avg_risk")
PERFORMANCE_COLUMNS = REPORT_COLUMNS[REPORT_COLUMNS.index("accuracy") :]
FLAG_COLUMNS = REPORT_FLAGS


def melt(report: DataFrame, ids: list[str], values: list[str], variable: str, value: str) -> DataFrame:
    return report.unpivot(ids, values, variable, value)


def risk_long(report: DataFrame) -> DataFrame:
    return melt(report, ["batch_name"], list(RISK_COLUMNS), "risk_type", "risk_value")


def performance_long(report: DataFrame) -> DataFrame:
    return melt(report, ["batch_name"], list(PERFORMANCE_COLUMNS), "metric", "value")


def overview(report: DataFrame) -> DataFrame:
    anomalous = F.count_if("anomaly_detected")
    return report.agg(
        F.count("*").alias("total_batches"),
        (F.count("*") - anomalous).alias("normal_batches"),
        anomalous.alias("anomalous_batches"),
        F.round(F.max("max_feature_drift_score"), 4).alias("highest_drift_score"),
    )


def anomalous(report: DataFrame) -> DataFrame:
    return report.where(F.col("anomaly_detected"))


def batch_row(report: DataFrame, name: str) -> DataFrame:
    return report.where(F.col("batch_name") == name)


def kpi_cards(report: DataFrame) -> DataFrame:
    """Rounded headline figures per batch; the missing share as a percentage."""
    rounded = (
        "fraud_rate_actual", "avg_predicted_risk", "baseline_avg_risk", "accuracy", "roc_auc",
        "f1_score", "precision", "recall", "prediction_drift_score", "max_feature_drift_score",
    )
    return report.select(
        "batch_name",
        "rows",
        *[F.round(c, 4).alias(c) for c in rounded],
        F.round(F.col("missing_percentage") * 100, 2).alias("missing_value_percent"),
        "duplicate_rows",
    )


def format_flags(report: DataFrame) -> DataFrame:
    return report.withColumns({c: flag_label(c) for c in FLAG_COLUMNS})


def status(report: DataFrame) -> DataFrame:
    return report.select("batch_name", status_label("anomaly_detected").alias("status"))


def assign_severity(report: DataFrame) -> DataFrame:
    return report.withColumn("severity", severity())
