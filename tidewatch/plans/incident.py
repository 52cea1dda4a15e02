"""Severity-rated incident texts for anomalous batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import incident_prompt, incident_text
from tidewatch.operators.attribution import render_table, top_changes
from tidewatch.operators.reporting import anomalous, assign_severity
from tidewatch.schema import BATCH_COLUMN


def with_context(report: DataFrame, comparison: DataFrame, n: int = 10) -> DataFrame:
    """Report rows with severity and a table of the largest attribution changes.

    A comparison with a batch column gives each batch its own changes (none: the table's head alone); one
    without it is of a single batch, and its table stands in every row.
    """
    rated = assign_severity(report)
    if BATCH_COLUMN not in comparison.columns:
        return rated.withColumn("top_changes", render_table(top_changes(comparison, n)).scalar())
    own = render_table(top_changes(comparison, n, [BATCH_COLUMN]), [BATCH_COLUMN])
    none = render_table(comparison.limit(0)).scalar()
    joined = rated.join(own.withColumnRenamed(BATCH_COLUMN, "batch_name"), "batch_name", "left")
    return joined.withColumn("top_changes", F.coalesce("top_changes", none))


def incidents(report: DataFrame, comparison: DataFrame, n: int = 10) -> DataFrame:
    rows = with_context(anomalous(report), comparison, n)
    return rows.select("batch_name", "severity", incident_text().alias("summary"))


def incident_prompts(report: DataFrame, comparison: DataFrame, n: int = 10) -> DataFrame:
    rows = with_context(anomalous(report), comparison, n)
    return rows.select("batch_name", incident_prompt().alias("prompt"))


def incident_lookup(report: DataFrame, comparison: DataFrame, n: int = 10) -> DataFrame:
    """Every batch with its incident; NULL where none was raised."""
    rows = with_context(report, comparison, n)
    raised = F.col("anomaly_detected")
    return rows.select(
        "batch_name",
        F.when(raised, F.col("severity")).alias("severity"),
        F.when(raised, incident_text()).alias("summary"),
    )


def get_incident(incident_rows: DataFrame, batch: str) -> DataFrame:
    return incident_rows.where(F.col("batch_name") == batch).select("summary")
