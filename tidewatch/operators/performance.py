"""Classification quality per batch from a score and a 0/1 label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import ordered
from tidewatch.schema import BASELINE_SOURCE, BATCH_COLUMN, SOURCE_COLUMN, TARGET, MonitorConfig


def predict_label(score: str | Column, threshold: float) -> Column:
    """1 when the score reaches the threshold (inclusive), else 0; NULL stays NULL."""
    score = F.col(score) if isinstance(score, str) else score
    return (score >= threshold).cast("int")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, 0 when the denominator is 0."""
    return F.when(denominator == 0, F.lit(0.0)).otherwise(F.try_divide(numerator, denominator))


def confusion_counts(label: Column, predicted: Column, weight: Column | None = None) -> list[Column]:
    """Aggregates tp, fp, fn, tn; ``weight`` counts each input row that many times."""
    def tally(actual, guess, name):
        hit = (label == actual) & (predicted == guess)
        if weight is None:
            return F.count_if(hit).alias(name)
        return F.coalesce(F.sum(F.when(hit, weight)), F.lit(0)).alias(name)

    return [tally(1, 1, "tp"), tally(0, 1, "fp"), tally(1, 0, "fn"), tally(0, 0, "tn")]


def confusion(
    df: DataFrame, keys=(BATCH_COLUMN,), label: str = TARGET, predicted: str = "predicted_label"
) -> DataFrame:
    return df.groupBy(*keys).agg(*confusion_counts(F.col(label), F.col(predicted)))


def classification_metrics(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 from tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        "*",
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
    )


def score_histogram(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Rows, positives and negatives per distinct score: all later metrics derive from it,
    so an expensive score is computed once per row. A score of NaN is a missing one."""
    known = F.nanvl(F.col(score).cast("double") + F.lit(0.0), F.lit(None).cast("double"))
    return df.groupBy(*keys, known.alias("score")).agg(
        F.count("*").alias("n"),
        F.count_if(F.col(label) == 1).alias("pos"),
        F.count_if(F.col(label) == 0).alias("neg"),
    )


def score_performance(
    df: DataFrame,
    keys: list[str],
    score: str,
    label: str = TARGET,
    threshold: float = MonitorConfig.score_threshold,
    buckets: int | None = None,
) -> DataFrame:
    """Per key: rows, positive rate, mean score, confusion counts and exact ROC-AUC.

    ROC-AUC is the share of (positive, negative) pairs ranked rightly, ties counting
    half; NULL when a class is absent. Rows without score or label count in ``rows``
    only.
    """
    return histogram_performance(score_histogram(df, keys, score, label), keys, threshold, buckets)


def histogram_performance(
    hist: DataFrame, keys: list[str], threshold: float = MonitorConfig.score_threshold, buckets: int | None = None
) -> DataFrame:
    """As :func:`score_performance`, from counts by score."""
    hist, widths = ordered.sized(hist, None, buckets)
    hist = hist.where(ordered.non_negative(["n", "pos", "neg"]))
    # One cut list for all keys keeps the broadcast independent of their number.
    rows = ordered.with_buckets(hist.withColumn("_series", F.lit("score")), "_series", "score", widths)
    rows = rows.drop("_series").withColumn(
        "below", F.when(F.col("score").isNotNull(), F.col("neg")).otherwise(F.lit(0))
    )
    if widths:
        rows = ordered.add_heads(rows, "score", [ordered.bucket_heads(rows, list(keys), ["below"], widths)])
    else:
        rows = rows.withColumn(ordered.HEAD, F.lit(False))
    ranked = ordered.running_counts(
        rows, list(keys), [F.col("score").asc_nulls_first()], "below", widths
    ).where(~F.col(ordered.HEAD))

    scored = F.col("score").isNotNull()
    pos = F.coalesce(F.sum(F.when(scored, F.col("pos"))), F.lit(0))
    neg = F.coalesce(F.sum(F.when(scored, F.col("neg"))), F.lit(0))
    # Twice the rightly ranked pairs, kept integral: counts of counts exceed 64 bits.
    pairs = F.sum(
        F.when(
            scored,
            F.col("pos").cast("decimal(18,0)")
            * (2 * F.col("below_le") - F.col("neg")).cast("decimal(18,0)"),
        )
    )
    predicted = predict_label("score", threshold)

    def tally(count, guess, name):
        return F.coalesce(F.sum(F.when(predicted == guess, F.col(count))), F.lit(0)).alias(name)

    return ranked.groupBy(*keys).agg(
        F.sum("n").alias("rows"),
        F.try_divide(F.sum("pos"), F.sum(F.col("pos") + F.col("neg"))).alias("fraud_rate_actual"),
        F.try_divide(
            F.sum(F.col("score") * F.col("n")), F.sum(F.when(scored, F.col("n")))
        ).alias("avg_predicted_risk"),
        tally("pos", 1, "tp"),
        tally("neg", 1, "fp"),
        tally("pos", 0, "fn"),
        tally("neg", 0, "tn"),
        F.try_divide(
            pairs.cast("double"), F.lit(2.0) * pos.cast("double") * neg.cast("double")
        ).alias("roc_auc"),
    )


def roc_auc(
    df: DataFrame,
    keys=(BATCH_COLUMN,),
    score: str = "score",
    label: str = TARGET,
    buckets: int | None = None,
) -> DataFrame:
    return score_performance(df, list(keys), score, label, buckets=buckets).select(*keys, "roc_auc")


def batch_performance(
    txn: DataFrame,
    score: str,
    label: str = TARGET,
    batch: str = BATCH_COLUMN,
    config: MonitorConfig = MonitorConfig(),
) -> DataFrame:
    """One row per batch, the baseline included and marked ``is_baseline``."""
    df = txn.select(
        F.col(batch).alias("batch_name"),
        (F.col(SOURCE_COLUMN) == BASELINE_SOURCE).alias("is_baseline"),
        F.col(score).alias("_score"),
        F.col(label).alias("_label"),
    )
    counts = score_performance(
        df,
        ["batch_name", "is_baseline"],
        "_score",
        "_label",
        config.score_threshold,
        config.range_buckets,
    )
    return classification_metrics(counts)


def class_weight(df: DataFrame, label: str = TARGET) -> DataFrame:
    """Class counts and the weight of a positive row: negatives / positives."""
    negative, positive = F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)
    return df.agg(
        negative.alias("negative_count"),
        positive.alias("positive_count"),
        F.try_divide(negative, positive).alias("scale_pos_weight"),
    )
