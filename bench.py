"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up, then $BENCH_RUNS times; its figure is the median.
Every run builds its plan anew, so no shuffle output is carried over.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

from tidewatch.catalog.queries import QUERIES, baseline  # noqa: E402
from tidewatch.catalog.view import transactions  # noqa: E402
from tidewatch.operators.model import TrainConfig, train  # noqa: E402
from tidewatch.plans.explain import batch_importance  # noqa: E402
from tidewatch.schema import TAG_COLUMNS  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
HEADLINE = (
    "feature_drift",
    "feature_drift_ranges",
    "roc_auc",
    "roc_auc_ranges",
    "data_quality",
    "risk_profile",
    "missing_by_batch",
    "high_risk_by_batch",
    "attribution_compare",
    "split_sizes",
    "sample_sizes",
    "document_duplicates",
    "monitoring_report",
)
TREES = 10  # of 200: training them all would take most of the run; explaining goes over all rows


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.files.maxPartitionBytes", "2m")  # the tables are small beside the cores
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        run = lambda: QUERIES[name](spark, SF_DIR).collect()
        run()
        seconds[name] = round(statistics.median(timed(run) for _ in range(RUNS)), 3)

    txn = transactions(spark, SF_DIR)
    base = baseline(txn).drop(*TAG_COLUMNS)
    models = []
    seconds[f"train_{TREES}_trees"] = round(timed(lambda: models.append(train(base, TrainConfig(trees=TREES)))), 3)
    seconds["importance_all_rows"] = round(timed(lambda: batch_importance(models[0], txn).collect()), 3)

    print(
        json.dumps(
            {
                "metric": "monitoring queries, sum of median warm seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
