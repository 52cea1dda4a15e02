"""The validation aggregates on the unified table, and SQL text run against it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.schema import BATCH_COLUMN, SOURCE_COLUMN, MonitorConfig

SCORE = "fraud_probability_simulated"

# Column -> name of its missing count.
MISSING_COUNTS = {
    "amount": "missing_amount",
    "login_velocity_24h": "missing_login_velocity",
    "device_trust_score": "missing_device_trust_score",
    "ip_risk_score": "missing_ip_risk_score",
    "merchant_risk_score": "missing_merchant_risk_score",
}


def volume_by_source(txn: DataFrame) -> DataFrame:
    return txn.groupBy(SOURCE_COLUMN).agg(F.count("*").alias("total_rows"))


def risk_profile(txn: DataFrame, score_alias: str = "avg_simulated_fraud_probability") -> DataFrame:
    def mean(column, digits, alias):
        return F.round(F.avg(column), digits).alias(alias)

    return (
        txn.groupBy(BATCH_COLUMN, "batch_type")
        .agg(
            F.count("*").alias("total_transactions"),
            mean("label_fraud", 4, "fraud_rate"),
            mean(SCORE, 4, score_alias),
            mean("amount", 2, "avg_transaction_amount"),
            mean("login_velocity_24h", 2, "avg_login_velocity"),
            mean("device_trust_score", 4, "avg_device_trust_score"),
            mean("ip_risk_score", 4, "avg_ip_risk_score"),
            mean("merchant_risk_score", 4, "avg_merchant_risk_score"),
        )
        .orderBy(BATCH_COLUMN, "batch_type")
    )


def missing_by_batch(txn: DataFrame, counts: dict[str, str] | None = None) -> DataFrame:
    counts = MISSING_COUNTS if counts is None else counts
    return (
        txn.groupBy(BATCH_COLUMN)
        .agg(*[F.count_if(F.col(c).isNull()).alias(alias) for c, alias in counts.items()])
        .orderBy(BATCH_COLUMN)
    )


def high_risk(txn: DataFrame, threshold: float = MonitorConfig.score_threshold) -> DataFrame:
    return txn.where(F.col(SCORE) >= threshold)


def high_risk_by_batch(txn: DataFrame, threshold: float = MonitorConfig.score_threshold) -> DataFrame:
    """Most high-risk rows first; batches without any do not appear."""
    return (
        high_risk(txn, threshold)
        .groupBy(BATCH_COLUMN)
        .agg(
            F.count("*").alias("high_risk_transactions"),
            F.round(F.avg(SCORE), 4).alias("avg_simulated_risk"),
        )
        .orderBy(F.desc("high_risk_transactions"), BATCH_COLUMN)
    )


def validate(txn: DataFrame, sql: str) -> DataFrame:
    """Run SQL text in which ``{transactions}`` stands for the table; no view of the session is touched."""
    return txn.sparkSession.sql(sql, transactions=txn)
