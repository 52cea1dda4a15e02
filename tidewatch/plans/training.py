"""Train on the baseline, evaluate on its held-out part."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.boosting import BoostConfig, BoostedModel, save_boosted, score_boosted, train_boosted
from tidewatch.operators.model import TrainConfig, save_model, score, train
from tidewatch.operators.performance import class_weight, classification_metrics, score_performance
from tidewatch.operators.sampling import train_test_split
from tidewatch.schema import DROP_COLUMNS, TAG_COLUMNS, TARGET, MonitorConfig, column_roles
from tidewatch.session import run_folder
from tidewatch.sources.outputs import log_metrics, save_confusion

RUN_NAME = "baseline_gbt_model"
EVALUATION_METRICS = ("accuracy", "roc_auc", "f1_score", "precision", "recall")
EVALUATION_PARAMS = (
    "model_type", "n_estimators", "max_depth", "learning_rate", "scale_pos_weight",
    "fraud_threshold", "train_rows", "test_rows", "categorical_features", "numeric_features",
)


@dataclass(frozen=True)
class TrainResult:
    model: PipelineModel | BoostedModel
    evaluation: DataFrame
    split: DataFrame


def train_and_evaluate(
    baseline: DataFrame,
    config: TrainConfig = TrainConfig(),
    monitor: MonitorConfig = MonitorConfig(),
    boosting: BoostConfig | None = None,
) -> TrainResult:
    """Split, fit, score the held-out rows, and gather metrics, counts and parameters.

    The split is written to the shared folder: boosting passes over the training rows
    many times and must not repeat the baseline's own plan each time. With ``boosting`` the trees are
    those that learn where missing numbers go, with its settings; ``config`` then only sets the split.
    """
    spark = baseline.sparkSession
    path = run_folder(spark, "split")
    train_test_split(baseline, TARGET, config.test_size, config.seed).write.parquet(path)
    split = spark.read.parquet(path)
    training = split.where(F.col("split") == "train").drop("split")
    held_out = split.where(F.col("split") == "test").drop("split")

    if boosting is None:
        model = train(training, config)
        scored, settings = score(model, held_out), config
    else:
        model = train_boosted(training, boosting)
        scored, settings = score_boosted(model, held_out), boosting
    categorical, numeric = column_roles(training, (*DROP_COLUMNS, TARGET, *TAG_COLUMNS))
    metrics = classification_metrics(
        score_performance(
            scored.withColumn("run_name", F.lit(RUN_NAME)),
            ["run_name"],
            "score",
            threshold=monitor.score_threshold,
            buckets=monitor.range_buckets,
        )
    )
    balance = class_weight(training).select(
        F.struct("scale_pos_weight", "negative_count", "positive_count")
    )
    evaluation = metrics.withColumn("_balance", balance.scalar()).select(
        "run_name",
        F.lit("Gradient-boosted trees").alias("model_type"),
        F.lit(settings.trees).alias("n_estimators"),
        F.lit(settings.depth).alias("max_depth"),
        F.lit(settings.learning_rate).alias("learning_rate"),
        "_balance.scale_pos_weight",
        F.lit(monitor.score_threshold).alias("fraud_threshold"),
        (F.col("_balance.negative_count") + F.col("_balance.positive_count")).alias("train_rows"),
        F.col("rows").alias("test_rows"),
        F.lit(", ".join(categorical)).alias("categorical_features"),
        F.lit(", ".join(numeric)).alias("numeric_features"),
        *EVALUATION_METRICS,
        "tp",
        "fp",
        "fn",
        "tn",
    )
    return TrainResult(model, evaluation, split)


def save_run(spark: SparkSession, result: TrainResult, folder: str) -> None:
    """What a run leaves behind, below one folder: the model, the confusion table, parameters and metrics."""
    if isinstance(result.model, BoostedModel):
        save_boosted(spark, result.model, f"{folder}/model")
    else:
        save_model(result.model, f"{folder}/model")
    save_confusion(result.evaluation, f"{folder}/confusion", keys=("run_name",))
    log_metrics(result.evaluation, f"{folder}/log", run_name="run_name", params=EVALUATION_PARAMS, metrics=EVALUATION_METRICS)
