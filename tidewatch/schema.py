"""Transaction schema, column roles, monitoring settings and missing-value normalisation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TARGET = "label_fraud"

# Identifiers and the simulated score: never model inputs.
DROP_COLUMNS = (
    "transaction_id",
    "batch_id",
    "batch_type",
    "event_timestamp",
    "account_id",
    "fraud_probability_simulated",
)

NUMERIC_FEATURES = (
    "amount",
    "account_age_days",
    "prior_chargebacks",
    "login_velocity_24h",
    "device_trust_score",
    "ip_risk_score",
    "merchant_risk_score",
    "transaction_hour",
)

CATEGORICAL_FEATURES = ("channel", "country", "merchant_category", "payment_method")

# Columns added when sources are tagged; not part of the original data.
SOURCE_COLUMN = "data_source"
BATCH_COLUMN = "batch_file_name"
TAG_COLUMNS = (SOURCE_COLUMN, BATCH_COLUMN)

BASELINE_SOURCE = "baseline"
PRODUCTION_SOURCE = "production_batch"

# Text-file types. Numbers are read as double because a writer that had gaps in
# an integer column prints 12 as 12.0; the timestamp is never parsed and stays text.
TEXT_TYPES: dict[str, T.DataType] = {
    **{c: T.StringType() for c in DROP_COLUMNS[:-1]},
    "fraud_probability_simulated": T.DoubleType(),
    **{c: T.DoubleType() for c in NUMERIC_FEATURES},
    **{c: T.StringType() for c in CATEGORICAL_FEATURES},
    TARGET: T.DoubleType(),
}

# Cell texts that count as missing, besides the empty cell.
MISSING_TOKENS = (
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null", "",
)

# The report's column names, their order and types.
REPORT_SCHEMA = T.StructType(
    [
        T.StructField("batch_name", T.StringType()),
        T.StructField("rows", T.LongType()),
        T.StructField("fraud_rate_actual", T.DoubleType()),
        T.StructField("avg_predicted_risk", T.DoubleType()),
        T.StructField("baseline_avg_risk", T.DoubleType()),
        T.StructField("prediction_drift_score", T.DoubleType()),
        T.StructField("prediction_drift_detected", T.BooleanType()),
        T.StructField("max_feature_drift_score", T.DoubleType()),
        T.StructField("most_drifted_feature", T.StringType()),
        T.StructField("feature_drift_detected", T.BooleanType()),
        T.StructField("missing_percentage", T.DoubleType()),
        T.StructField("duplicate_rows", T.LongType()),
        T.StructField("data_quality_issue_detected", T.BooleanType()),
        T.StructField("anomaly_detected", T.BooleanType()),
        T.StructField("accuracy", T.DoubleType()),
        T.StructField("roc_auc", T.DoubleType()),
        T.StructField("f1_score", T.DoubleType()),
        T.StructField("precision", T.DoubleType()),
        T.StructField("recall", T.DoubleType()),
    ]
)

REPORT_COLUMNS = tuple(REPORT_SCHEMA.names)
REPORT_DECIMALS = tuple(f.name for f in REPORT_SCHEMA if f.dataType == T.DoubleType())
# The flags of single issues, and last the one of any issue.
REPORT_FLAGS = tuple(f.name for f in REPORT_SCHEMA if f.dataType == T.BooleanType())

IMPORTANCE_SCHEMA = T.StructType(
    [T.StructField("feature", T.StringType()), T.StructField("mean_abs_shap", T.DoubleType())]
)

COMPARISON_SCHEMA = T.StructType(
    [
        T.StructField("feature", T.StringType()),
        T.StructField("mean_abs_shap_baseline", T.DoubleType()),
        T.StructField("mean_abs_shap_drift_batch", T.DoubleType()),
        T.StructField("shap_impact_change", T.DoubleType()),
    ]
)


@dataclass(frozen=True)
class MonitorConfig:
    """Thresholds of the monitoring checks; every comparison is inclusive (>=)."""

    score_threshold: float = 0.30
    feature_drift_threshold: float = 0.15
    prediction_drift_threshold: float = 0.05
    missing_threshold: float = 0.05
    # Value ranges per ordered statistic; None derives them from the size of its histogram.
    range_buckets: int | None = None


def require_columns(df: DataFrame, columns) -> DataFrame:
    """Fail at plan time when a column is absent (``drop`` would ignore it silently)."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")
    return df


def column_roles(df: DataFrame, exclude=(*DROP_COLUMNS, TARGET, *TAG_COLUMNS)):
    """Split the feature columns by type: strings are categorical, the rest numeric."""
    fields = [f for f in df.schema.fields if f.name not in set(exclude)]
    categorical = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    numeric = [f.name for f in fields if not isinstance(f.dataType, T.StringType)]
    return categorical, numeric


def normalise_missing(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL once, so that every later operator needs NULL logic only."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(
        *[
            F.when(~F.isnan(c), F.col(c)).alias(c) if c in floating else F.col(c)
            for c in df.columns
        ]
    )
