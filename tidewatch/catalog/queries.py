"""Registered queries: every operator on data derived from the provided tables."""

from __future__ import annotations

from functools import lru_cache

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.catalog.view import SCORE_INTERCEPT, SCORE_WEIGHTS, table, transactions
from tidewatch.functions.text import clean_batch_name
from tidewatch.operators import attribution as att
from tidewatch.operators import performance as perf
from tidewatch.operators import quality, reporting, validation
from tidewatch.operators.boosting import BoostConfig, best_splits, first_level, model_nodes, score_boosted, train_boosted, width_cuts
from tidewatch.operators.drift import feature_drift, feature_drift_flag, numeric_features, prediction_drift
from tidewatch.operators.model import (
    TrainConfig,
    feature_frame,
    feature_label,
    feature_sums,
    fit_encoder,
    load_model,
    save_model,
    score,
)
from tidewatch.operators.dictionary import fit_dictionary, slot_counts, slots
from tidewatch.operators.sampling import sample_n, sample_per_key, train_test_split
from tidewatch.operators.tree_shap import explain_rows, tree_shap_columns, tree_shap_rows
from tidewatch.plans.explain import batch_importance, compare_batches
from tidewatch.plans.incident import incident_lookup, incident_prompts, incidents
from tidewatch.plans.monitor import load_profile, monitor, save_profile
from tidewatch.plans.training import EVALUATION_METRICS, EVALUATION_PARAMS, train_and_evaluate
from tidewatch.schema import (
    BASELINE_SOURCE,
    BATCH_COLUMN,
    DROP_COLUMNS,
    REPORT_COLUMNS,
    SOURCE_COLUMN,
    TAG_COLUMNS,
    TARGET,
    column_roles,
)
from tidewatch.session import run_folder, stored
from tidewatch.sources import outputs
from tidewatch.sources import transactions as sources
from tidewatch.streaming.monitor_stream import monitor_stream, read_batches

SCORE = "fraud_probability_simulated"
EXPLAINED_BATCH = "batch_02_feature_drift.csv"
VALIDATION_TEXT = """
WITH payments AS (SELECT data_source, channel, amount FROM {transactions} WHERE amount IS NOT NULL),
means AS (SELECT data_source, channel, avg(amount) AS mean FROM payments GROUP BY data_source, channel)
SELECT p.data_source, p.channel, count(*) AS payments, count_if(amount >= mean) AS large_payments,
       round(sum(CASE WHEN amount >= mean THEN amount END) / sum(amount), 6) AS large_share
FROM payments AS p JOIN means AS m ON p.data_source <=> m.data_source AND p.channel <=> m.channel
GROUP BY p.data_source, p.channel
"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as the order of a floating sum is not fixed; -0.0 becomes 0.0."""
    return df.select(
        *[
            (F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c)
            for c, t in df.dtypes
        ]
    )


def production(txn: DataFrame) -> DataFrame:
    return txn.where(F.col(SOURCE_COLUMN) != BASELINE_SOURCE)


def baseline(txn: DataFrame) -> DataFrame:
    return txn.where(F.col(SOURCE_COLUMN) == BASELINE_SOURCE)


def joined_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unified table as written rows, for queries that read it several times: the largest table they leave."""
    return stored(transactions(spark, sf_dir), "joined", compression="zstd")


def report(spark: SparkSession, sf_dir: str, txn: DataFrame | None = None) -> DataFrame:
    return monitor(joined_once(spark, sf_dir) if txn is None else txn, SCORE)


def comparison(spark: SparkSession, sf_dir: str, txn: DataFrame | None = None) -> DataFrame:
    """Importance change of one batch under the linear weights, for all batches' incidents.

    Rows need their features only, and each keeps its own key, so copies count as rows.
    """
    txn = transactions(spark, sf_dir) if txn is None else txn
    importance = att.mean_abs(
        att.linear_attribution(txn, SCORE_WEIGHTS, baseline(txn), [SOURCE_COLUMN, BATCH_COLUMN]),
        [SOURCE_COLUMN, BATCH_COLUMN],
    )
    return compare_batches(importance)


def one_comparison(spark, sf_dir, txn=None):
    return comparison(spark, sf_dir, txn).where(F.col(BATCH_COLUMN) == EXPLAINED_BATCH).drop(BATCH_COLUMN)


def write_batches(spark: SparkSession, sf_dir: str) -> str:
    """Production rows as text, one directory per batch, below a new folder."""
    path = run_folder(spark, "batches")
    rows = production(transactions(spark, sf_dir)).drop(SOURCE_COLUMN)
    rows.write.partitionBy(BATCH_COLUMN).option("header", True).csv(path)
    return path


# ---- sources and sinks -------------------------------------------------------------

LOADED = ("transaction_id", "amount", "ip_risk_score", "transaction_hour", "channel", "label_fraud")


def q_load_batch(spark, sf_dir):
    path, name = run_folder(spark, "batch"), "batch_04_quality_issue.csv"
    rows = transactions(spark, sf_dir).where(F.col(BATCH_COLUMN) == name).drop(*TAG_COLUMNS)
    rows.write.option("header", True).csv(f"{path}/{name}")
    return sources.load_batch(spark, path, name).select(*LOADED)


def q_load_baseline(spark, sf_dir):
    path = run_folder(spark, "baseline")
    baseline(transactions(spark, sf_dir)).drop(*TAG_COLUMNS).write.option("header", True).csv(f"{path}/train.csv")
    return sources.load_baseline(spark, f"{path}/train.csv").select(*LOADED)


def q_load_all_batches(spark, sf_dir):
    return sources.load_batches(spark, write_batches(spark, sf_dir)).select(BATCH_COLUMN, *LOADED)


def q_batch_shapes(spark, sf_dir):
    return sources.describe_inputs(transactions(spark, sf_dir))


SHORT_HEADER = [c for c in LOADED if c != "ip_risk_score"][::-1]


def mixed_batches(spark, sf_dir):
    """Text batches of two headers: later ones have fewer columns, in another order."""
    path = run_folder(spark, "mixed")
    rows = production(transactions(spark, sf_dir)).drop(SOURCE_COLUMN)
    short = F.col(BATCH_COLUMN) >= "batch_03"
    for part, columns in ((rows.where(~short), rows.columns), (rows.where(short), [*SHORT_HEADER, BATCH_COLUMN])):
        part.select(*columns).write.mode("append").partitionBy(BATCH_COLUMN).option("header", True).csv(path)
    return path


def q_mixed_headers(spark, sf_dir):
    """Batches whose headers differ, read by column name."""
    return sources.load_batches(spark, mixed_batches(spark, sf_dir), same_header=False).select(BATCH_COLUMN, *LOADED)


def q_mixed_shapes(spark, sf_dir):
    """Rows and the columns that each batch's own files have."""
    path = mixed_batches(spark, sf_dir)
    batches = sources.load_batches(spark, path, same_header=False)
    return sources.describe_inputs(batches, catalogue=sources.header_catalogue(spark, path))


def q_column_listing(spark, sf_dir):
    """Which columns each batch's files name, and where."""
    catalogue = sources.header_catalogue(spark, mixed_batches(spark, sf_dir))
    return catalogue.select(BATCH_COLUMN, "position", "column_name").distinct()


def q_snapshot_table(spark, sf_dir):
    """The unified table replaced by versions: the baseline alone, then all."""
    root, txn = run_folder(spark, "snapshots"), transactions(spark, sf_dir)
    sources.save_snapshot(baseline(txn), root)
    sources.save_snapshot(txn, root)
    return validation.risk_profile(sources.load_snapshot(spark, root))


def q_transactions_table(spark, sf_dir):
    path = run_folder(spark, "transactions")
    sources.save_transactions_at(transactions(spark, sf_dir), path)
    return validation.risk_profile(sources.load_transactions(spark, path))


def q_report_roundtrip(spark, sf_dir):
    path = run_folder(spark, "report")
    outputs.save_report(report(spark, sf_dir), path, "csv")
    return rounded(outputs.load_report(spark, path, "csv"))


def q_attribution_roundtrip(spark, sf_dir):
    path = run_folder(spark, "attribution")
    outputs.save_attribution(one_comparison(spark, sf_dir), path, "csv")
    return rounded(outputs.load_attribution(spark, path, fmt="csv"))


def q_metric_log(spark, sf_dir):
    return rounded(outputs.log_rows(report(spark, sf_dir)))


def q_run_log(spark, sf_dir):
    """The newest run of each batch's log, after an older run and a repeated write of the newest."""
    path, rows = run_folder(spark, "log"), stored(report(spark, sf_dir), "reported")
    outputs.log_metrics(rows.withColumn("rows", F.lit(0)), path, "first")
    for _ in range(2):
        outputs.log_metrics(rows, path, "second")
    return rounded(outputs.latest_runs(outputs.load_log(spark, path)).drop("ts", "run_id"))


def q_incident_files(spark, sf_dir):
    path = run_folder(spark, "incidents")
    outputs.save_incidents(q_incidents(spark, sf_dir), path)
    return outputs.load_incidents(spark, path).select(
        "incident", F.rtrim(F.col("value"), F.lit("\n")).alias("summary")
    )


# ---- projection, filters, text ----------------------------------------------------


def q_transactions(spark, sf_dir):
    return transactions(spark, sf_dir).withColumn(
        "event_timestamp", F.date_format("event_timestamp", "yyyy-MM-dd HH:mm:ss")
    )


def q_union_sources(spark, sf_dir):
    """Baseline and batches apart, the batches lacking one column, joined by name."""
    txn = transactions(spark, sf_dir)
    base = baseline(txn).drop(*TAG_COLUMNS)
    batches = production(txn).drop(SOURCE_COLUMN, "ip_risk_score")
    return (
        sources.union_sources(base, batches)
        .groupBy(SOURCE_COLUMN, BATCH_COLUMN)
        .agg(F.count("*").alias("total_rows"), F.count("ip_risk_score").alias("with_ip_risk_score"))
    )


def q_feature_projection(spark, sf_dir):
    return feature_frame(transactions(spark, sf_dir))


def q_feature_label(spark, sf_dir):
    """Rows by channel and label, the label split off as a number."""
    txn = transactions(spark, sf_dir)
    tagged = feature_label(txn).select("channel", TARGET)
    return tagged.groupBy("channel", TARGET).agg(F.count("*").alias("total_rows"))


def q_column_roles(spark, sf_dir):
    """Each feature column, its role by type, and how many cells it has."""
    txn = transactions(spark, sf_dir)
    categorical, numeric = column_roles(txn)
    counts = txn.agg(*[F.count(c).alias(c) for c in [*categorical, *numeric]])
    roles = [(c, role) for role, names in (("categorical", categorical), ("numeric", numeric)) for c in names]
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(role).alias("role"), F.col(c).alias("known")) for c, role in roles]
    return counts.select(F.inline(F.array(*rows)))


def q_high_risk(spark, sf_dir):
    return validation.high_risk(transactions(spark, sf_dir)).select("transaction_id", BATCH_COLUMN, SCORE)


def q_scored(spark, sf_dir):
    scored = att.score_linear(transactions(spark, sf_dir), SCORE_WEIGHTS, SCORE_INTERCEPT, digits=5)
    return scored.select(
        "transaction_id", BATCH_COLUMN, "score", perf.predict_label("score", 0.30).alias("predicted_label")
    )


# ---- aggregates -------------------------------------------------------------------


def q_validation_sql(spark, sf_dir):
    return validation.validate(transactions(spark, sf_dir), VALIDATION_TEXT)


def scored_counts(spark, sf_dir):
    txn = transactions(spark, sf_dir)
    return perf.confusion(txn.withColumn("predicted_label", perf.predict_label(SCORE, 0.30)))


def q_data_quality(spark, sf_dir):
    return rounded(quality.data_quality(production(transactions(spark, sf_dir))), 8)


def q_missing_share(spark, sf_dir):
    return rounded(quality.missing_share(transactions(spark, sf_dir)), 8)


def q_confusion_table(spark, sf_dir):
    return outputs.confusion_table(scored_counts(spark, sf_dir), [BATCH_COLUMN])


def q_classification_metrics(spark, sf_dir):
    return rounded(perf.classification_metrics(scored_counts(spark, sf_dir)))


def q_roc_auc(spark, sf_dir):
    return rounded(perf.roc_auc(transactions(spark, sf_dir), score=SCORE), 9)


def q_class_balance(spark, sf_dir):
    return rounded(perf.class_weight(baseline(transactions(spark, sf_dir))))


# ---- drift and report -------------------------------------------------------------


def q_feature_drift(spark, sf_dir):
    return rounded(feature_drift(transactions(spark, sf_dir)), 9)


def q_feature_drift_ranges(spark, sf_dir):
    """The same distances through eight value ranges per feature."""
    return rounded(feature_drift(transactions(spark, sf_dir), buckets=8), 9)


def q_roc_auc_ranges(spark, sf_dir):
    return rounded(perf.roc_auc(transactions(spark, sf_dir), score=SCORE, buckets=8), 9)


def q_feature_drift_flag(spark, sf_dir):
    txn = transactions(spark, sf_dir)
    features = numeric_features(txn)
    return rounded(feature_drift_flag(feature_drift(txn, features), features), 9)


def q_prediction_drift(spark, sf_dir):
    by_batch = perf.batch_performance(transactions(spark, sf_dir), SCORE)
    return rounded(
        prediction_drift(by_batch).select(
            "batch_name",
            "avg_predicted_risk",
            "baseline_avg_risk",
            "prediction_drift_score",
            "prediction_drift_detected",
        )
    )


def q_monitoring_report(spark, sf_dir):
    return rounded(report(spark, sf_dir))


def q_profile_report(spark, sf_dir):
    """The report on production rows alone, against a stored profile of the baseline."""
    txn = joined_once(spark, sf_dir)
    path, features = run_folder(spark, "profile"), numeric_features(txn)
    save_profile(baseline(txn), SCORE, features, path)
    return rounded(monitor(production(txn), SCORE, profile=load_profile(spark, path, features)))


def q_stream_report(spark, sf_dir):
    """The report of a stream in which every batch has two shares, split over micro-batches of four files."""
    txn = joined_once(spark, sf_dir)
    path, features = run_folder(spark, "stream"), numeric_features(txn)
    save_profile(baseline(txn), SCORE, features, f"{path}/profile")
    arriving = production(txn).drop(SOURCE_COLUMN)
    share = F.pmod(F.xxhash64("transaction_id"), F.lit(2))
    arriving.repartition(F.col(BATCH_COLUMN), share).write.partitionBy(BATCH_COLUMN).parquet(f"{path}/batches")
    batches = read_batches(spark, f"{path}/batches", arriving.schema, max_files=4)
    profile = load_profile(spark, f"{path}/profile", features)
    stream = monitor_stream(batches, profile, lambda df: df, f"{path}/report", f"{path}/state", SCORE)
    stream.trigger(availableNow=True).start().awaitTermination()
    return rounded(spark.read.parquet(f"{path}/report").select(*REPORT_COLUMNS))


def q_event_value_drift(spark, sf_dir):
    """Daily batches of events against the first week."""
    first_week = F.col("ts") < F.lit("2024-01-08").cast("timestamp_ntz")
    day = F.date_format("ts", "yyyy-MM-dd")
    events = table(spark, sf_dir, "events").select(
        F.when(first_week, "first_week").otherwise(day).alias(BATCH_COLUMN),
        F.when(first_week, "baseline").otherwise("production_batch").alias(SOURCE_COLUMN),
        "value",
    )
    return rounded(feature_drift(events, ["value"]), 9)


def q_document_duplicates(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("source", "text")
    return quality.duplicate_rows(documents, ["source"], ["text"])


def q_label_performance(spark, sf_dir):
    """A length-based score judged against the toxicity label, per language."""
    judged = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    scored = judged.select(
        "lang", "toxic", F.round(1 / (1 + F.col("n_chars") / F.lit(2000.0)), 6).alias("score")
    )
    counts = perf.score_performance(scored, ["lang"], "score", "toxic", threshold=0.5)
    return rounded(perf.classification_metrics(counts))


# ---- views of the report ----------------------------------------------------------


def q_risk_long(spark, sf_dir):
    return rounded(reporting.risk_long(report(spark, sf_dir)))


def q_performance_long(spark, sf_dir):
    return rounded(reporting.performance_long(report(spark, sf_dir)))


def q_selected_batch(spark, sf_dir):
    return rounded(reporting.batch_row(report(spark, sf_dir), "batch_03_prediction_drift.csv"))


def q_kpi_cards(spark, sf_dir):
    return reporting.kpi_cards(report(spark, sf_dir))


def q_flag_labels(spark, sf_dir):
    labelled = report(spark, sf_dir)
    return (
        reporting.format_flags(labelled)
        .select("batch_name", *reporting.FLAG_COLUMNS)
        .withColumn(
            "status",
            F.when(F.col("anomaly_detected") == "Detected", "Anomaly Detected").otherwise("Normal Batch"),
        )
    )


def q_status(spark, sf_dir):
    return reporting.status(report(spark, sf_dir))


def q_severity(spark, sf_dir):
    return reporting.assign_severity(report(spark, sf_dir)).select("batch_name", "severity")


def q_overview(spark, sf_dir):
    return reporting.overview(report(spark, sf_dir))


def q_anomalous(spark, sf_dir):
    return reporting.anomalous(report(spark, sf_dir)).select(
        clean_batch_name("batch_name").alias("batch"), "most_drifted_feature"
    )


# ---- attribution and incidents ----------------------------------------------------


def q_linear_attribution(spark, sf_dir):
    txn = transactions(spark, sf_dir)
    keys = ["transaction_id", BATCH_COLUMN]
    return rounded(att.linear_attribution(production(txn), SCORE_WEIGHTS, baseline(txn), keys))


def q_mean_abs_attribution(spark, sf_dir):
    txn = transactions(spark, sf_dir)
    phi = att.linear_attribution(txn, SCORE_WEIGHTS, baseline(txn), [BATCH_COLUMN])
    return rounded(att.mean_abs(phi, [BATCH_COLUMN]))


def q_attribution_rank(spark, sf_dir):
    txn = transactions(spark, sf_dir)
    phi = att.linear_attribution(baseline(txn), SCORE_WEIGHTS, baseline(txn), [])
    return rounded(att.rank_importance(att.mean_abs(phi)))


def q_attribution_compare(spark, sf_dir):
    return rounded(comparison(spark, sf_dir))


def q_top_changes(spark, sf_dir):
    return rounded(att.top_changes(one_comparison(spark, sf_dir), 3))


def q_top_changes_text(spark, sf_dir):
    return att.render_table(att.top_changes(one_comparison(spark, sf_dir)))


def q_incidents(spark, sf_dir):
    txn = joined_once(spark, sf_dir)
    return incidents(report(spark, sf_dir, txn), one_comparison(spark, sf_dir, txn))


def q_batch_incidents(spark, sf_dir):
    """Every incident with the changes of its own batch."""
    txn = joined_once(spark, sf_dir)
    return incidents(report(spark, sf_dir, txn), comparison(spark, sf_dir, txn))


def q_incident_prompt(spark, sf_dir):
    txn = joined_once(spark, sf_dir)
    return incident_prompts(report(spark, sf_dir, txn), one_comparison(spark, sf_dir, txn))


def q_incident_lookup(spark, sf_dir):
    txn = joined_once(spark, sf_dir)
    return incident_lookup(report(spark, sf_dir, txn), one_comparison(spark, sf_dir, txn))


# ---- sampling and model -----------------------------------------------------------


def q_sample_n(spark, sf_dir):
    return sample_n(transactions(spark, sf_dir), 500).select("transaction_id", BATCH_COLUMN)


def q_sample_total(spark, sf_dir):
    """How many rows the sample has, and how many of them are rows of the table."""
    ids = transactions(spark, sf_dir).select("transaction_id").distinct()
    sample = q_sample_n(spark, sf_dir)
    return sample.join(ids, "transaction_id", "left_semi").agg(F.count("*").alias("sampled"))


def q_sample_sizes(spark, sf_dir):
    sample = sample_per_key(transactions(spark, sf_dir), [BATCH_COLUMN], 500)
    return sample.groupBy(BATCH_COLUMN).agg(F.count("*").alias("sampled"))


def q_train_test_split(spark, sf_dir):
    return train_test_split(baseline(transactions(spark, sf_dir))).select("transaction_id", TARGET, "split")


def q_split_sizes(spark, sf_dir):
    split = train_test_split(baseline(transactions(spark, sf_dir)))
    return split.groupBy("split", TARGET).agg(F.count("*").alias("total_rows"))


def q_one_hot(spark, sf_dir):
    """Rows per batch in each one-hot slot, encoded with the baseline's categories."""
    txn = transactions(spark, sf_dir)
    categorical, _ = column_roles(txn)
    return slot_counts(txn, fit_dictionary(baseline(txn), categorical), categorical, [BATCH_COLUMN])


def q_category_dictionary(spark, sf_dir):
    """The baseline's categories with their numbers and one-hot slots."""
    txn = transactions(spark, sf_dir)
    categorical, _ = column_roles(txn)
    return slots(fit_dictionary(baseline(txn), categorical), categorical)


def q_encoded_features(spark, sf_dir):
    """Every encoded feature's sum and cells other than 0 per batch, encoded as the baseline has it."""
    txn = transactions(spark, sf_dir)
    sums = feature_sums(fit_encoder(baseline(txn)), txn, [BATCH_COLUMN])
    return rounded(sums, 3)


@lru_cache(maxsize=4)
def trained(application: str, sf_dir: str, trees: int = TrainConfig.trees):
    """The model of one input folder, fitted once per application."""
    spark = SparkSession.getActiveSession()
    base = baseline(transactions(spark, sf_dir)).drop(*TAG_COLUMNS)
    return train_and_evaluate(base, TrainConfig(trees=trees))


def fitted_model(spark: SparkSession, sf_dir: str) -> PipelineModel:
    return trained(spark.sparkContext.applicationId, sf_dir).model


def q_train_eval(spark, sf_dir):
    return trained(spark.sparkContext.applicationId, sf_dir).evaluation


def q_train_facts(spark, sf_dir):
    """The part of the evaluation that does not depend on which rows were drawn."""
    evaluation = trained(spark.sparkContext.applicationId, sf_dir, 10).evaluation
    return rounded(
        evaluation.select(
            *[c for c in EVALUATION_PARAMS if c != "model_type"],
            (F.col("tp") + F.col("fn")).alias("test_positives"),
            (F.col("tn") + F.col("fp")).alias("test_negatives"),
        )
    )


def q_model_roundtrip(spark, sf_dir):
    """Rows per batch, and how many of them the stored model scores otherwise than the one it was stored from."""
    path, model = run_folder(spark, "model"), trained(spark.sparkContext.applicationId, sf_dir, 10).model
    save_model(model, path)
    both = score(load_model(path), score(model, transactions(spark, sf_dir), "before"), "after")
    return both.groupBy(BATCH_COLUMN).agg(
        F.count("*").alias("total_rows"), F.count_if(~F.col("before").eqNullSafe(F.col("after"))).alias("changed")
    )


def q_train_log(spark, sf_dir):
    return outputs.log_rows(
        q_train_eval(spark, sf_dir), "run_name", EVALUATION_PARAMS, EVALUATION_METRICS
    )


def q_gbt_scores(spark, sf_dir):
    return score(fitted_model(spark, sf_dir), transactions(spark, sf_dir)).select(
        "transaction_id", BATCH_COLUMN, "score"
    )


def q_gbt_report(spark, sf_dir):
    txn = joined_once(spark, sf_dir)
    return monitor(score(fitted_model(spark, sf_dir), txn), "score", columns=quality.original_columns(txn))


def q_tree_shap(spark, sf_dir):
    """Every row's attributions, the encoded values they belong to, and the expected log-odds.

    The importances are a mean of these; ``explain_batches`` has them for all batches.
    """
    return tree_shap_rows(fitted_model(spark, sf_dir), transactions(spark, sf_dir), ["transaction_id", BATCH_COLUMN])


def q_explain_batches(spark, sf_dir):
    return compare_batches(batch_importance(fitted_model(spark, sf_dir), transactions(spark, sf_dir)))


def q_gbt_report_facts(spark, sf_dir):
    """The part of the trained model's report that does not depend on its scores."""
    return rounded(
        q_gbt_report(spark, sf_dir).select(
            "batch_name",
            "rows",
            "fraud_rate_actual",
            "max_feature_drift_score",
            "most_drifted_feature",
            "missing_percentage",
            "duplicate_rows",
        )
    )


def _additivity(attributions, model, spark, sf_dir):
    txn = transactions(spark, sf_dir)
    margin = F.get(vector_to_array("rawPrediction"), F.lit(1))
    rows = model.transform(txn).select(*txn.columns, margin.alias("margin"))
    total = F.aggregate("phi", F.lit(0.0), lambda a, v: a + v) + F.col("expected")
    return (
        attributions(model, rows, [BATCH_COLUMN, "margin"])
        .groupBy(BATCH_COLUMN)
        .agg(
            F.count("*").alias("total_rows"),
            F.round(F.max(F.abs(total - 2 * F.col("margin"))), 9).alias("largest_gap"),
        )
    )


def q_shap_additivity(spark, sf_dir):
    """Largest gap between a row's attributions plus expectation and its log-odds, per batch."""
    return _additivity(tree_shap_rows, fitted_model(spark, sf_dir), spark, sf_dir)


def q_shap_columns_additivity(spark, sf_dir):
    """The same gap of the attributions by built-in functions, whose work per row follows the trees: ten of them."""
    model = trained(spark.sparkContext.applicationId, sf_dir, 10).model
    return _additivity(tree_shap_columns, model, spark, sf_dir)


def q_explain_rows(spark, sf_dir):
    """The three largest attributions of every row, with the feature's value."""
    model, txn = fitted_model(spark, sf_dir), transactions(spark, sf_dir)
    return explain_rows(model, txn, ["transaction_id", BATCH_COLUMN], 3)


def q_explained_amounts(spark, sf_dir):
    """All attributions of all rows: how many there are of each number, and the sum of the values explained."""
    model, txn = fitted_model(spark, sf_dir), transactions(spark, sf_dir)
    known = [c for c in column_roles(txn)[1] if c != "ip_risk_score"]  # that one has gaps, filled with a mean
    long = explain_rows(model, txn, ["transaction_id", BATCH_COLUMN], features=known)
    return (
        long.where(F.col("feature").isin(known))
        .groupBy(BATCH_COLUMN, "feature")
        .agg(F.count("*").alias("total_rows"), F.round(F.sum("value"), 2).alias("sum_value"))
    )


def q_split_rows(spark, sf_dir):
    """Both parts of the split together: every baseline row, once per copy."""
    return train_test_split(baseline(transactions(spark, sf_dir))).drop("split").select(
        "transaction_id", "amount", TARGET
    )


SPLIT_BINS = 8


def _first_level(spark, sf_dir):
    # Features and label only: the ends, the class ratio and the histogram each pass over them.
    txn = stored(transactions(spark, sf_dir).drop(*DROP_COLUMNS, *TAG_COLUMNS), "joined")
    categorical, numeric = column_roles(txn)
    cuts = width_cuts(txn, numeric, SPLIT_BINS)
    names = F.array(*[F.lit(c) for c in [*numeric, *categorical]])
    return first_level(txn, numeric, categorical, TARGET, cuts), names, len(numeric)


def q_split_histogram(spark, sf_dir):
    """Gradient and hessian sums behind the first split on all rows, missing cells in a bin of their own."""
    histogram, names, _ = _first_level(spark, sf_dir)
    return histogram.select(F.get(names, "feature").alias("feature"), "bin", "category", "n", "g", "h")


def q_root_split(spark, sf_dir):
    """The first split on all rows and where its missing cells go."""
    histogram, names, numbers = _first_level(spark, sf_dir)
    return best_splits(histogram, numbers, BoostConfig()).select(
        F.get(names, F.col("best.feature")).alias("feature"),
        "best.bin",
        "best.category",
        "best.missing_left",
        F.round("best.gain", 4).alias("gain"),
        "best.left_g",
        "best.left_h",
        "g",
        "h",
    )


BOOSTED = BoostConfig(trees=10, learning_rate=0.3)


@lru_cache(maxsize=4)
def boosted(application: str, sf_dir: str):
    """Trees on all rows, missing cells included, fitted once per application."""
    spark = SparkSession.getActiveSession()
    # Not from written rows: approximate quantiles follow the order in which rows come.
    return train_boosted(transactions(spark, sf_dir), BOOSTED)


def q_boosted_nodes(spark, sf_dir):
    """Every node of the trees, with the direction of missing cells."""
    return model_nodes(spark, boosted(spark.sparkContext.applicationId, sf_dir))


def q_boosted_report(spark, sf_dir):
    """The monitoring report on the scores of these trees."""
    txn = joined_once(spark, sf_dir)
    scored = score_boosted(boosted(spark.sparkContext.applicationId, sf_dir), txn)
    return monitor(scored, "score", columns=quality.original_columns(txn))


def on_transactions(operator):
    return lambda spark, sf_dir: operator(transactions(spark, sf_dir))


QUERIES = {
    "load_batch": q_load_batch,
    "load_baseline": q_load_baseline,
    "load_all_batches": q_load_all_batches,
    "batch_shapes": q_batch_shapes,
    "mixed_headers": q_mixed_headers,
    "mixed_shapes": q_mixed_shapes,
    "column_listing": q_column_listing,
    "snapshot_table": q_snapshot_table,
    "transactions_table": q_transactions_table,
    "report_roundtrip": q_report_roundtrip,
    "attribution_roundtrip": q_attribution_roundtrip,
    "metric_log": q_metric_log,
    "run_log": q_run_log,
    "incident_files": q_incident_files,
    "transactions": q_transactions,
    "union_sources": q_union_sources,
    "feature_projection": q_feature_projection,
    "feature_label": q_feature_label,
    "column_roles": q_column_roles,
    "high_risk": q_high_risk,
    "scored": q_scored,
    "volume_by_source": on_transactions(validation.volume_by_source),
    "risk_profile": on_transactions(validation.risk_profile),
    "missing_by_batch": on_transactions(validation.missing_by_batch),
    "high_risk_by_batch": on_transactions(validation.high_risk_by_batch),
    "validation_sql": q_validation_sql,
    "data_quality": q_data_quality,
    "missing_share": q_missing_share,
    "confusion": scored_counts,
    "confusion_table": q_confusion_table,
    "classification_metrics": q_classification_metrics,
    "roc_auc": q_roc_auc,
    "roc_auc_ranges": q_roc_auc_ranges,
    "class_balance": q_class_balance,
    "feature_drift": q_feature_drift,
    "feature_drift_ranges": q_feature_drift_ranges,
    "feature_drift_flag": q_feature_drift_flag,
    "prediction_drift": q_prediction_drift,
    "monitoring_report": q_monitoring_report,
    "profile_report": q_profile_report,
    "stream_report": q_stream_report,
    "event_value_drift": q_event_value_drift,
    "document_duplicates": q_document_duplicates,
    "label_performance": q_label_performance,
    "risk_long": q_risk_long,
    "performance_long": q_performance_long,
    "selected_batch": q_selected_batch,
    "kpi_cards": q_kpi_cards,
    "flag_labels": q_flag_labels,
    "status": q_status,
    "severity": q_severity,
    "overview": q_overview,
    "anomalous": q_anomalous,
    "linear_attribution": q_linear_attribution,
    "mean_abs_attribution": q_mean_abs_attribution,
    "attribution_rank": q_attribution_rank,
    "attribution_compare": q_attribution_compare,
    "top_changes": q_top_changes,
    "top_changes_text": q_top_changes_text,
    "incidents": q_incidents,
    "batch_incidents": q_batch_incidents,
    "incident_prompt": q_incident_prompt,
    "incident_lookup": q_incident_lookup,
    "sample_n": q_sample_n,
    "sample_total": q_sample_total,
    "sample_sizes": q_sample_sizes,
    "train_test_split": q_train_test_split,
    "split_sizes": q_split_sizes,
    "split_rows": q_split_rows,
    "one_hot": q_one_hot,
    "category_dictionary": q_category_dictionary,
    "encoded_features": q_encoded_features,
    "train_eval": q_train_eval,
    "train_facts": q_train_facts,
    "model_roundtrip": q_model_roundtrip,
    "train_log": q_train_log,
    "gbt_scores": q_gbt_scores,
    "gbt_report": q_gbt_report,
    "gbt_report_facts": q_gbt_report_facts,
    "split_histogram": q_split_histogram,
    "root_split": q_root_split,
    "boosted_nodes": q_boosted_nodes,
    "boosted_report": q_boosted_report,
    "tree_shap": q_tree_shap,
    "shap_additivity": q_shap_additivity,
    "shap_columns_additivity": q_shap_columns_additivity,
    "explain_batches": q_explain_batches,
    "explain_rows": q_explain_rows,
    "explained_amounts": q_explained_amounts,
}
