"""Monitoring of batch files as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from tidewatch.operators.drift import value_histogram
from tidewatch.operators.performance import score_histogram
from tidewatch.operators.quality import digest_counts
from tidewatch.plans.monitor import BaselineProfile, monitor_counts
from tidewatch.schema import BATCH_COLUMN, PRODUCTION_SOURCE, TAG_COLUMNS, TARGET, MonitorConfig, normalise_missing
from tidewatch.sources.transactions import TEXT_OPTIONS, clean_text, tag_source, text_schema

# Partition columns: a batch by the hash of its name; the micro-batch.
KEY = "batch_key"
EPOCH = "arrived_epoch"
# Parts of a batch that are added up to a whole.
COMPACT_AFTER = 8
COUNTS = T.StructType(
    [
        T.StructField("batch_name", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("feature", T.IntegerType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("digest", T.BinaryType()),
        T.StructField("n", T.LongType()),
        T.StructField("pos", T.LongType()),
        T.StructField("neg", T.LongType()),
        T.StructField("missing", T.LongType()),
    ]
)


def read_batches(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    """Parquet batches below ``path``; each file (or partition directory) is a batch.

    The parts of a batch may come in several micro-batches, see :func:`monitor_stream`.
    """
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    df = reader.parquet(path)
    if BATCH_COLUMN not in schema.names:
        df = df.withColumn(BATCH_COLUMN, F.col("_metadata.file_name"))
    return normalise_missing(df)


def read_text_batches(
    spark: SparkSession, path: str, header: list[str], max_files: int | None = None
) -> DataFrame:
    """Text batches (``*.csv``) with the given header columns, cleaned as in a batch read."""
    reader = spark.readStream.schema(text_schema(header)).options(**TEXT_OPTIONS)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return clean_text(reader.csv(path))


def monitor_stream(
    batches: DataFrame,
    profile: BaselineProfile,
    scorer: Callable[[DataFrame], DataFrame],
    report_path: str,
    checkpoint: str,
    score: str = "score",
    config: MonitorConfig = MonitorConfig(),
    compact_after: int = COMPACT_AFTER,
) -> DataStreamWriter:
    """Report on every batch that has files among the arrived ones, over all its rows so far.

    ``scorer`` adds the score column. What is kept of the rows below the checkpoint is :class:`BatchCounts`: counts
    of values, scores and row digests per batch and micro-batch. A batch whose files come in several
    micro-batches is reported anew with each, from its counts, in its one directory of the report table, so
    the table has one row per batch. Rows that came before aren't read or scored again, nor is the baseline, whose
    profile is stored. A replay overwrites what its micro-batch wrote.
    """
    columns = [c for c in batches.columns if c not in TAG_COLUMNS]
    state = BatchCounts(f"{checkpoint.rstrip('/')}/counts", compact_after)

    def report_on(arrived: DataFrame, epoch: int) -> None:
        needed = dict.fromkeys([*columns, BATCH_COLUMN, score, *profile.features, TARGET])
        rows = tag_source(scorer(arrived).select(*needed), PRODUCTION_SOURCE).persist()
        try:
            keys = state.add(rows, profile.features, score, columns, epoch)
        finally:
            rows.unpersist()
        if not keys:
            return
        so_far = state.read(arrived.sparkSession, keys, epoch)
        report = monitor_counts(*parts_of(so_far), len(columns), profile, config)
        _replace(report.withColumn(KEY, batch_key("batch_name")), [KEY], report_path)

    return batches.writeStream.foreachBatch(report_on).option("checkpointLocation", checkpoint)


def batch_key(name: str) -> Column:
    """A batch by the hash of its name, so that any name gives a plain path."""
    return F.sha2(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary"), 256)


def counts_of(rows: DataFrame, features: list[str], score: str, columns: list[str]) -> DataFrame:
    """Counts of tagged and scored rows: by feature and value, by score, and by row digest, one below the other."""
    values = value_histogram(rows, features).drop("is_baseline").withColumn("kind", F.lit("value"))
    named = rows.withColumn("batch_name", F.col(BATCH_COLUMN))
    scores = score_histogram(named, ["batch_name"], score, TARGET).withColumn("kind", F.lit("score"))
    digests = digest_counts(named, ["batch_name"], columns).withColumn("kind", F.lit("row"))
    counted = values.unionByName(scores.withColumnRenamed("score", "value"), allowMissingColumns=True).unionByName(
        digests.withColumnsRenamed({"_digest": "digest", "copies": "n"}), allowMissingColumns=True
    )
    return counted.select(*[F.col(f.name).cast(f.dataType) for f in COUNTS])


def added(counts: DataFrame) -> DataFrame:
    """Counts of the same things added up; nulls among them stay apart from zeros."""
    named = ("batch_name", "kind", "feature", "value", "digest")
    return counts.groupBy(*named).agg(*[F.sum(c).alias(c) for c in ("n", "pos", "neg", "missing")])


def parts_of(counts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The value, score and digest counts as their own operators give them."""
    of = lambda kind: counts.where(F.col("kind") == kind)
    values = of("value").select("feature", "batch_name", F.lit(False).alias("is_baseline"), "value", "n")
    scores = of("score").select("batch_name", F.col("value").alias("score"), "n", "pos", "neg")
    digests = of("row").select("batch_name", F.col("digest").alias("_digest"), F.col("n").alias("copies"), "missing")
    return values, scores, digests


class BatchCounts:
    """Counts of each batch on disk: ``parts`` by micro-batch, and ``whole`` ones that stand for all parts up to theirs.

    A reader at a micro-batch takes the newest whole before it and the parts after that, so a replay meets what
    the first try met, whatever was written since. When a batch has ``compact_after`` such parts they are added up to
    a new whole; what only older wholes needed is then removed. Each is one directory, moved into place at once.
    """

    def __init__(self, path: str, compact_after: int = COMPACT_AFTER):
        self.path, self.compact_after = path, compact_after

    def add(self, rows: DataFrame, features: list[str], score: str, columns: list[str], epoch: int) -> list[str]:
        """Write the counts of one micro-batch; returns the keys of the batches it has rows of."""
        spark = rows.sparkSession
        counts = counts_of(rows, features, score, columns)
        keyed = counts.withColumns({KEY: batch_key("batch_name"), EPOCH: F.lit(epoch).cast("long")})
        _replace(keyed, [KEY, EPOCH], f"{self.path}/parts")
        keys = [r[0] for r in rows.select(batch_key(BATCH_COLUMN)).distinct().collect()]
        for key in keys:
            whole, parts = self._standing(spark, key, epoch)
            if len(parts) > self.compact_after:
                merged = added(self._rows(spark, [(key, whole, parts)])).withColumns({KEY: F.lit(key), EPOCH: F.lit(epoch).cast("long")})
                _replace(merged.coalesce(max(1, len(parts) // 4)), [KEY, EPOCH], f"{self.path}/whole")
                self._forget(spark, key, whole)
        return keys

    def read(self, spark: SparkSession, keys: list[str], epoch: int) -> DataFrame:
        """The counts of these batches over all micro-batches up to one."""
        return added(self._rows(spark, [(k, *self._standing(spark, k, epoch)) for k in keys]))

    def _standing(self, spark: SparkSession, key: str, epoch: int) -> tuple[int | None, list[int]]:
        whole = max((e for e in self._epochs(spark, "whole", key) if e < epoch), default=None)
        parts = [e for e in self._epochs(spark, "parts", key) if e <= epoch and (whole is None or e > whole)]
        return whole, parts

    def _rows(self, spark: SparkSession, standing: list[tuple[str, int | None, list[int]]]) -> DataFrame:
        folders = []
        for key, whole, parts in standing:
            folders += [f"{self.path}/whole/{KEY}={key}/{EPOCH}={whole}"] if whole is not None else []
            folders += [f"{self.path}/parts/{KEY}={key}/{EPOCH}={e}" for e in parts]
        return spark.read.schema(COUNTS).parquet(*folders)

    def _epochs(self, spark: SparkSession, kind: str, key: str) -> list[int]:
        folder = _path(spark, f"{self.path}/{kind}/{KEY}={key}")
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        names = [x.getPath().getName() for x in files.listStatus(folder)]
        return [int(n.split("=")[1]) for n in names if n.startswith(f"{EPOCH}=")]

    def _forget(self, spark: SparkSession, key: str, whole: int | None) -> None:
        """Remove what stands before the whole that a replay of this micro-batch would read."""
        for kind, last in (("parts", whole), ("whole", None if whole is None else whole - 1)):
            for e in self._epochs(spark, kind, key):
                if last is not None and e <= last:
                    folder = _path(spark, f"{self.path}/{kind}/{KEY}={key}/{EPOCH}={e}")
                    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _path(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def _replace(df: DataFrame, keys: list[str], path: str) -> None:
    """Write the partitions that ``df`` has rows of; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
