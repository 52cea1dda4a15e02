"""Drift of feature distributions and of mean scores against the baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators import ordered
from tidewatch.schema import (
    BASELINE_SOURCE,
    BATCH_COLUMN,
    SOURCE_COLUMN,
    MonitorConfig,
    column_roles,
    require_columns,
)


def numeric_features(txn: DataFrame) -> list[str]:
    numeric = column_roles(txn)[1]
    if not numeric:
        raise ValueError("no numeric feature to compare")
    return numeric


def value_histogram(txn: DataFrame, features: list[str], batch: str = BATCH_COLUMN) -> DataFrame:
    """Rows per (feature position, batch, value). A missing value leaves a row with count 0,
    so every (batch, feature) pair stays present even when all its values are missing."""
    # Adding zero makes -0.0 and 0.0 one value. NaN is a missing value.
    values = F.array(*[F.nanvl(F.col(c).cast("double") + F.lit(0.0), F.lit(None).cast("double")) for c in features])
    return (
        txn.select(
            F.col(batch).alias("batch_name"),
            (F.col(SOURCE_COLUMN) == BASELINE_SOURCE).alias("is_baseline"),
            F.posexplode(values).alias("feature", "value"),
        )
        .groupBy("feature", "batch_name", "is_baseline", "value")
        .agg(F.count("value").alias("n"))
    )


def feature_drift(
    txn: DataFrame,
    features: list[str] | None = None,
    batch: str = BATCH_COLUMN,
    buckets: int | None = None,
    baseline_histogram: DataFrame | None = None,
) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance of every (batch, numeric feature).

    The baseline is accumulated once per feature and shared by all batches. Between
    two neighbouring batch values only the baseline moves, so the largest gap lies at
    a batch value or just below one: testing both limits there covers the baseline's
    own values without pairing the baseline with every batch. A side without values
    gives 0. Without ``buckets`` the value counts are written first, and their number sets the
    ranges. A stored ``baseline_histogram`` of the same features stands in for baseline
    rows of ``txn``, which then needs production rows only.
    """
    features = list(features) if features is not None else numeric_features(txn)
    require_columns(txn, [*features, batch, SOURCE_COLUMN])
    hist = value_histogram(txn, features, batch)
    if baseline_histogram is not None:
        hist = hist.unionByName(baseline_histogram)
    return histogram_drift(hist, features, buckets)


def histogram_drift(hist: DataFrame, features: list[str], buckets: int | None = None) -> DataFrame:
    """As :func:`feature_drift`, from value counts of baseline and batches."""
    hist, widths = ordered.sized(hist, "feature", buckets)
    hist = hist.where(ordered.non_negative(["n"]))
    rows = (
        ordered.with_buckets(hist, "feature", "value", widths)
        .withColumn("base", F.when(F.col("is_baseline"), F.col("n")).otherwise(F.lit(0)))
        .withColumn("own", F.when(F.col("is_baseline"), F.lit(0)).otherwise(F.col("n")))
        .drop("n")
    )
    if widths:
        rows = ordered.add_heads(
            rows,
            "value",
            [
                ordered.bucket_heads(rows, ["feature"], ["base"], widths),
                ordered.bucket_heads(rows, ["feature", "batch_name", "is_baseline"], ["own"], widths),
            ],
        ).withColumn("is_baseline", F.coalesce("is_baseline", F.lit(True)))
    else:
        rows = rows.withColumn(ordered.HEAD, F.lit(False))

    # A baseline row comes first among equal values, so every batch row sees it: the last
    # baseline value met tells whether the baseline has this very value, and how often.
    value_first = F.col("value").asc_nulls_first()
    met = F.when(F.col("is_baseline"), F.struct("value", "base"))
    shared = ordered.running_counts(
        rows,
        ["feature"],
        [value_first, F.col("is_baseline").desc()],
        "base",
        widths,
        {"met": lambda frame: F.last(met, ignorenulls=True).over(frame)},
    ).where(~F.col("is_baseline"))
    base_at = F.when(F.col("met.value") == F.col("value"), F.col("met.base")).otherwise(F.lit(0))
    both = ordered.running_counts(
        shared.withColumn("base_at", base_at).drop("met"),
        ["feature", "batch_name"],
        [value_first],
        "own",
        widths,
    )

    def gap(base, own):
        return F.abs(F.try_divide(base, F.col("base_total")) - F.try_divide(own, F.col("own_total")))

    here = gap(F.col("base_le"), F.col("own_le"))
    just_below = gap(F.col("base_le") - F.col("base_at"), F.col("own_le") - F.col("own"))
    return (
        both.where(~F.col(ordered.HEAD))
        .groupBy("batch_name", "feature")
        .agg(
            F.coalesce(
                F.max(F.when(F.col("value").isNotNull(), F.greatest(here, just_below))), F.lit(0.0)
            ).alias("ks")
        )
        .withColumn("feature", F.get(F.array(*[F.lit(f) for f in features]), F.col("feature")))
    )


def feature_drift_flag(
    drift: DataFrame, features: list[str], config: MonitorConfig = MonitorConfig()
) -> DataFrame:
    """Largest distance per batch, its feature (the first in column order on ties), and the flag."""
    position = F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature"))
    return drift.groupBy("batch_name").agg(
        F.max("ks").alias("max_feature_drift_score"),
        F.max_by("feature", F.struct(F.col("ks"), -position)).alias("most_drifted_feature"),
        (F.max("ks") >= config.feature_drift_threshold).alias("feature_drift_detected"),
    )


def prediction_drift(by_batch: DataFrame, config: MonitorConfig = MonitorConfig()) -> DataFrame:
    """Distance of each batch's mean score from the baseline's.

    Input: one row per batch with ``is_baseline`` and ``avg_predicted_risk``. The
    window spans these few rows only, never transactions.
    """
    everything = Window.partitionBy(F.lit(0))
    baseline = F.max(F.when(F.col("is_baseline"), F.col("avg_predicted_risk"))).over(everything)
    return (
        by_batch.withColumn("baseline_avg_risk", baseline)
        .where(~F.col("is_baseline"))
        .withColumn(
            "prediction_drift_score", F.abs(F.col("avg_predicted_risk") - F.col("baseline_avg_risk"))
        )
        .withColumn(
            "prediction_drift_detected",
            F.coalesce(
                F.col("prediction_drift_score") >= config.prediction_drift_threshold, F.lit(False)
            ),
        )
        .drop("is_baseline")
    )
