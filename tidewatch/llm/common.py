"""Small helpers that several text operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import run_folder

# Rows handled at once inside a task; texts are long, so slices stay small.
SLICE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Two columns only, ``doc_id`` and ``text``, a missing text being empty; others can't clash."""
    return docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_column), F.lit("")).alias("text"),
    )


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a new table in the shared folder: computed once, and safe from lost executors."""
    spark = df.sparkSession
    path = run_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def held_out(doc_id: Column | str) -> Column:
    """The rows no model learns from: a third of the documents, by their id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1
