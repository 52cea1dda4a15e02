"""The unified table derived from the provided order tables, batches being ship years.

1995-96 is the baseline; later years are production batches. 1998 shifts one feature,
1999 shifts another (and with it the score), 2000 loses values and repeats rows.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Weights of the simulated score, on the features' own scales.
SCORE_INTERCEPT = -4.0
SCORE_WEIGHTS = {
    "login_velocity_24h": 0.04,
    "merchant_risk_score": 1.0,
    "ip_risk_score": 0.8,
    "device_trust_score": -0.5,
    "amount": 0.000005,
}


@lru_cache(maxsize=256)
def _schema(application: str, path: str) -> StructType:
    return SparkSession.getActiveSession().read.parquet(path).schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A provided table; its footer is read for the schema once per application."""
    path = f"{sf_dir}/{name}.parquet"
    return spark.read.schema(_schema(spark.sparkContext.applicationId, path)).parquet(path)


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables are joined without broadcast hints: all of them grow with the data,
    so their sizes decide at run time."""
    year = F.year("l_shipdate")
    joined = (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    rows = joined.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("transaction_id"),
        F.concat(F.lit("B"), year).alias("batch_id"),
        F.when(year <= 1996, "baseline")
        .when(year == 1998, "feature_drift")
        .when(year == 1999, "prediction_drift")
        .when(year == 2000, "quality_issue")
        .otherwise("normal")
        .alias("batch_type"),
        F.col("l_shipdate").alias("event_timestamp"),
        F.col("o_custkey").cast("string").alias("account_id"),
        F.col("l_extendedprice").alias("amount"),
        (F.col("o_custkey") % 1000).cast("int").alias("account_age_days"),
        F.col("l_linenumber").alias("prior_chargebacks"),
        F.when(year == 1998, F.col("l_quantity") * 1.5)
        .otherwise(F.col("l_quantity"))
        .alias("login_velocity_24h"),
        (F.col("l_discount") * 10.0).alias("device_trust_score"),
        F.when(~((year == 2000) & (F.col("l_orderkey") % 10 == 0)), F.col("l_tax") * 12.5).alias(
            "ip_risk_score"
        ),
        (F.col("p_size") / 50.0 + F.when(year == 1999, 0.5).otherwise(0.0)).alias("merchant_risk_score"),
        (F.col("l_partkey") % 24).cast("int").alias("transaction_hour"),
        F.col("o_orderpriority").alias("channel"),
        F.col("n_name").alias("country"),
        F.col("p_type").alias("merchant_category"),
        F.col("c_mktsegment").alias("payment_method"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 40), 1)
        .otherwise(0)
        .alias("label_fraud"),
        F.col("l_orderkey").alias("_order"),
    )
    margin = (
        F.lit(-4.0)
        + F.lit(0.04) * F.col("login_velocity_24h")
        + F.col("merchant_risk_score")
        + F.lit(0.8) * F.coalesce("ip_risk_score", F.lit(0.0))
        - F.lit(0.5) * F.col("device_trust_score")
        + F.col("amount") / F.lit(200000.0)
    )
    repeated = (F.col("batch_type") == "quality_issue") & (F.col("_order") % 40 == 0)
    copies = F.when(repeated, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    batch = (
        F.when(F.col("batch_id").isin("B1995", "B1996"), "train_baseline.csv")
        .when(F.col("batch_id") == "B1997", "batch_01_normal.csv")
        .when(F.col("batch_id") == "B1998", "batch_02_feature_drift.csv")
        .when(F.col("batch_id") == "B1999", "batch_03_prediction_drift.csv")
        .when(F.col("batch_id") == "B2000", "batch_04_quality_issue.csv")
        .otherwise("batch_05_recent.csv")
    )
    source = F.when(F.col("batch_type") == "baseline", "baseline").otherwise("production_batch")
    kept = [c for c in rows.columns if c != "_order"]
    return rows.select(
        *kept,
        F.round(1 / (1 + F.exp(-margin)), 6).alias("fraud_probability_simulated"),
        # The second copy comes from the row itself, so the joins run once.
        F.explode(copies).alias("_copy"),
    ).select(
        *kept, "fraud_probability_simulated", source.alias("data_source"), batch.alias("batch_file_name")
    )
