"""The monitoring report: one row per production batch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.drift import (
    feature_drift,
    feature_drift_flag,
    histogram_drift,
    numeric_features,
    prediction_drift,
    value_histogram,
)
from tidewatch.operators.performance import batch_performance, classification_metrics, histogram_performance
from tidewatch.operators.quality import counted_digests, data_quality, original_columns, quality_flags
from tidewatch.schema import (
    BASELINE_SOURCE,
    BATCH_COLUMN,
    REPORT_COLUMNS,
    SOURCE_COLUMN,
    TARGET,
    MonitorConfig,
    require_columns,
)
from tidewatch.sources.transactions import union_sources


@dataclass(frozen=True)
class BaselineProfile:
    """What the report needs of the baseline: value counts per feature and the mean score.

    Batches that arrive later are compared with it, so baseline rows are neither read
    nor scored again.
    """

    features: list[str]
    histogram: DataFrame
    risk: DataFrame


def save_profile(baseline: DataFrame, score: str, features: list[str], path: str) -> None:
    """Write the profile of a tagged and scored baseline, with the names of its features and score."""
    value_histogram(baseline, features).write.mode("overwrite").parquet(f"{path}/histogram")
    names = F.array(*[F.lit(c) for c in features]).alias("features")
    risk = baseline.agg(F.avg(score).alias("avg_predicted_risk")).select("*", names, F.lit(score).alias("score"))
    risk.write.mode("overwrite").parquet(f"{path}/risk")


def load_profile(spark: SparkSession, path: str, features: list[str] | None = None) -> BaselineProfile:
    """A stored profile. The histogram knows its features by position, so their names are read back;
    ``features``, if given, must be the same ones."""
    risk = spark.read.parquet(f"{path}/risk")
    stored = list(risk.first()["features"])
    if features is not None and sorted(features) != sorted(stored):
        raise ValueError(f"the profile is of {stored}, not of {list(features)}")
    return BaselineProfile(stored, spark.read.parquet(f"{path}/histogram"), risk.select("avg_predicted_risk"))


def monitor(
    txn: DataFrame,
    score: str,
    label: str = TARGET,
    features: list[str] | None = None,
    config: MonitorConfig = MonitorConfig(),
    columns: list[str] | None = None,
    profile: BaselineProfile | None = None,
) -> DataFrame:
    """Report on every production batch of the unified table against its baseline rows.

    Three branches read the table, each with its own columns: score and label, the
    numeric features, and all original columns (for missing cells and duplicates).
    Each branch ends in one row per batch; only these are joined. ``columns`` names
    the original columns when ``txn`` carries added ones besides the score. With a
    ``profile`` the baseline comes from there, and baseline rows of ``txn`` are left out.
    """
    require_columns(txn, [SOURCE_COLUMN, BATCH_COLUMN, score, label])
    columns = columns or original_columns(txn)
    if profile is not None:  # the baseline comes from there, so its rows here would count twice
        features = profile.features
        txn = txn.where(F.col(SOURCE_COLUMN) != BASELINE_SOURCE)
    features = list(features) if features is not None else numeric_features(txn.select(*columns))

    by_batch = batch_performance(txn, score, label, config=config)
    stored = profile.histogram if profile is not None else None
    drift = feature_drift(txn, features, buckets=config.range_buckets, baseline_histogram=stored)
    production = txn.where(F.col(SOURCE_COLUMN) != BASELINE_SOURCE)
    quality = data_quality(production, [BATCH_COLUMN], columns, config).withColumnRenamed(
        BATCH_COLUMN, "batch_name"
    )
    return _assembled(by_batch, drift, quality, features, profile, config)


def monitor_counts(
    values: DataFrame,
    scores: DataFrame,
    digests: DataFrame,
    columns: int,
    profile: BaselineProfile,
    config: MonitorConfig = MonitorConfig(),
) -> DataFrame:
    """The same report from counts of production batches, which may have been added up from parts.

    ``values`` is as :func:`value_histogram` gives it, ``scores`` as ``score_histogram`` and ``digests`` as
    ``digest_counts`` by batch_name, of tables with so many ``columns``.
    """
    named = scores.withColumn("is_baseline", F.lit(False))
    counts = histogram_performance(named, ["batch_name", "is_baseline"], config.score_threshold, config.range_buckets)
    drift = histogram_drift(values.unionByName(profile.histogram), profile.features, config.range_buckets)
    quality = quality_flags(counted_digests(digests, ["batch_name"]), ["batch_name"], columns, config)
    return _assembled(classification_metrics(counts), drift, quality, profile.features, profile, config)


def _assembled(
    by_batch: DataFrame,
    drift: DataFrame,
    quality: DataFrame,
    features: list[str],
    profile: BaselineProfile | None,
    config: MonitorConfig,
) -> DataFrame:
    if profile is not None:
        risk = profile.risk.withColumn("is_baseline", F.lit(True))
        by_batch = by_batch.unionByName(risk, allowMissingColumns=True)
    performance = prediction_drift(by_batch, config)
    drift = feature_drift_flag(drift, features, config)
    return (
        performance.join(drift, "batch_name")
        .join(quality, "batch_name")
        .withColumn(
            "anomaly_detected",
            F.col("prediction_drift_detected")
            | F.col("feature_drift_detected")
            | F.col("data_quality_issue_detected"),
        )
        .select(*REPORT_COLUMNS)
    )


def monitor_frames(baseline: DataFrame, batches: DataFrame, score: str, **options) -> DataFrame:
    """As :func:`monitor`, for a baseline and batches held apart."""
    return monitor(union_sources(baseline, batches), score, **options)
