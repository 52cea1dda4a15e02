"""Baseline and production batches: text readers, tagging, union and the unified table.

A batch is one ``*.csv`` file, or one ``*.csv`` directory of part files as Spark
itself writes it. All batches form a single DataFrame with a batch column.
"""

from __future__ import annotations

import csv
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.schema import (
    BASELINE_SOURCE,
    BATCH_COLUMN,
    MISSING_TOKENS,
    PRODUCTION_SOURCE,
    SOURCE_COLUMN,
    TAG_COLUMNS,
    TARGET,
    TEXT_TYPES,
    normalise_missing,
)

# Last path component that ends in .csv (without its partition column), or the one above a part file.
_BATCH_OF_PATH = rf"(?:^|/)(?:{BATCH_COLUMN}=)?([^/]+\.csv)(?:/part-[^/]*)?$"

# enforceSchema=False makes Spark verify the header of every file against the declared columns
# instead of mapping by position. A quote inside quotes is doubled. FAILFAST fails on a line with too
# few or too many cells, such as half of one that a quoted line break splits (see ``multi_line``).
TEXT_OPTIONS = {
    "header": True,
    "enforceSchema": False,
    "escape": '"',
    "mode": "FAILFAST",
    "pathGlobFilter": "*.csv",
}


def _files(path: str) -> str:
    """A batch itself, or all batches of a folder: one level, so folders below it are none."""
    return path if path.rstrip("/").endswith(".csv") else f"{path.rstrip('/')}/*.csv"


def _header(spark: SparkSession, path: str) -> list[str]:
    """Column names of the first line; only that line is read."""
    return spark.read.options(header=True, escape='"', pathGlobFilter="*.csv").csv(_files(path)).columns


def text_schema(header: list[str]) -> T.StructType:
    """All cells as text; :func:`clean_text` gives them their types."""
    return T.StructType([T.StructField(c, T.StringType()) for c in header])


def clean_text(raw: DataFrame) -> DataFrame:
    """Missing tokens and NaN to NULL, numbers cast, the label integral, the batch name from the path.

    A cell that is neither missing nor a number where one belongs fails the read.
    """
    cells = []
    for c in raw.columns:
        known = F.when(~F.trim(c).isin(*MISSING_TOKENS), F.col(c))
        number = None if isinstance(TEXT_TYPES.get(c), T.StringType) else TEXT_TYPES.get(c)
        broken = F.raise_error(F.concat(F.lit(f"not a number in {c}: "), known))
        typed = F.coalesce(known.try_cast(number), F.when(known.isNotNull(), broken.cast(number))) if number else known
        cells.append(typed.alias(c))
    decoded = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    df = normalise_missing(raw.select(*cells, F.regexp_extract(decoded, _BATCH_OF_PATH, 1).alias(BATCH_COLUMN)))
    if TARGET in raw.columns:
        df = df.withColumn(TARGET, F.col(TARGET).cast("int"))
    return df


def _read_text(spark: SparkSession, paths: list[str], header: list[str], multi_line: bool = False) -> DataFrame:
    reader = spark.read.schema(text_schema(header)).options(**TEXT_OPTIONS, multiLine=multi_line)
    return clean_text(reader.csv(paths))


def load_baseline(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """``multi_line`` allows line breaks inside quotes, here and below; such files cannot be split."""
    return _read_text(spark, [_files(path)], _header(spark, path), multi_line).drop(BATCH_COLUMN)


def load_batch(spark: SparkSession, path: str, name: str, multi_line: bool = False) -> DataFrame:
    """One batch by name; only its files are opened."""
    target = f"{path.rstrip('/')}/{name}"
    return _read_text(spark, [target], _header(spark, target), multi_line).drop(BATCH_COLUMN)


def load_batches(
    spark: SparkSession, path: str, same_header: bool = True, multi_line: bool = False
) -> DataFrame:
    """Every batch in the folder ``path`` in one read, tagged with its batch name.

    With ``same_header`` a file whose header differs fails the job. Otherwise the files are grouped by
    header first (their first lines come from one distributed read) and joined by column name,
    absent columns becoming NULL.
    """
    if same_header:
        return _read_text(spark, [_files(path)], _header(spark, path), multi_line)
    by_header: dict[str, list[str]] = {}
    for row in _first_lines(spark, path).orderBy("line", "file").collect():
        by_header.setdefault(row["line"], []).append(row["file"])
    parts = [_read_text(spark, files, _names(line), multi_line) for line, files in by_header.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _first_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line), one row per file from one distributed read; like Spark's own listing of the folder, the driver can hold it."""
    lines = spark.read.options(pathGlobFilter="*.csv").text(_files(path))
    first = lines.where("_metadata.file_block_start = 0").groupBy(F.col("_metadata.file_path").alias("file"))
    return first.agg(F.first("value").alias("line"))


def _names(line: str) -> list[str]:
    return next(csv.reader([line.removeprefix("\ufeff")]))


def header_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(file, batch_file_name, position, column_name): what each file of a folder calls its columns.

    First lines come from one distributed read, and each different one is taken apart once.
    """
    files = _first_lines(spark, path)
    headers = [(r["line"], _names(r["line"])) for r in files.select("line").distinct().collect()]
    known = spark.createDataFrame(headers, "_line string, names array<string>")
    decoded = F.url_decode(F.replace(F.col("file"), F.lit("+"), F.lit("%2B")))
    named = files.join(known, F.col("line") == F.col("_line"))
    return named.select(
        "file", F.regexp_extract(decoded, _BATCH_OF_PATH, 1).alias(BATCH_COLUMN), F.posexplode("names").alias("position", "column_name")
    )


def tag_source(df: DataFrame, source: str, batch_name: str | None = None) -> DataFrame:
    df = df.withColumn(SOURCE_COLUMN, F.lit(source))
    return df if batch_name is None else df.withColumn(BATCH_COLUMN, F.lit(batch_name))


def union_sources(
    baseline: DataFrame, batches: DataFrame, baseline_name: str = "train_baseline.csv"
) -> DataFrame:
    """The unified table: columns matched by name, absent ones NULL, duplicates kept."""
    both = tag_source(baseline, BASELINE_SOURCE, baseline_name).unionByName(
        tag_source(batches, PRODUCTION_SOURCE), allowMissingColumns=True
    )
    return normalise_missing(both)


def describe_inputs(df: DataFrame, batch: str = BATCH_COLUMN, catalogue: DataFrame | None = None) -> DataFrame:
    """Rows and original column count per batch.

    With a ``catalogue`` of the files' headers a batch has the columns of its own files, whatever others have.
    """
    rows = df.groupBy(batch).agg(F.count("*").alias("rows"))
    if catalogue is None:
        return rows.withColumn("columns", F.lit(len([c for c in df.columns if c not in TAG_COLUMNS])))
    widths = catalogue.groupBy(F.col(BATCH_COLUMN).alias("_batch")).agg(F.count_distinct("column_name").cast("int").alias("columns"))
    return rows.join(widths, F.col(batch).eqNullSafe(F.col("_batch"))).drop("_batch")


def save_transactions(df: DataFrame, name: str, path: str | None = None) -> None:
    """Replace the unified table; one directory per batch gives partition pruning."""
    writer = df.write.mode("overwrite").format("parquet").partitionBy(BATCH_COLUMN)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


def save_transactions_at(df: DataFrame, path: str) -> None:
    """As :func:`save_transactions`, without a catalog entry."""
    df.write.mode("overwrite").partitionBy(BATCH_COLUMN).parquet(path)


def load_transactions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn(BATCH_COLUMN, F.col(BATCH_COLUMN).cast("string"))


def save_snapshot(df: DataFrame, root: str, keep: int = 2) -> str:
    """Replace the unified table below ``root`` in one step: readers see the former version until this one is whole.

    A version is a folder of its own; it counts once its name is published, which is the creation of one empty
    file. A write that fails leaves the former version. Versions before the newest ``keep`` are removed. Returns the version.
    """
    spark = df.sparkSession
    version = uuid.uuid4().hex
    save_transactions_at(df, f"{root}/version={version}")
    published = _published(spark, root)
    number = published[-1][0] + 1 if published else 0
    files, path = _at(spark, f"{root}/{_PUBLISHED}/{number:012d}-{version}")
    if not files.createNewFile(path):
        raise FileExistsError(f"version {version} is already published")
    for _, old in published[: max(0, len(published) + 1 - keep)]:
        files, path = _at(spark, f"{root}/version={old}")
        files.delete(path, True)
    return version


def load_snapshot(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """The newest published version, or a given one. A plan keeps reading the version it was made with."""
    published = _published(spark, root)
    if not published:
        raise FileNotFoundError(f"no version is published below {root}")
    return load_transactions(spark, f"{root}/version={version or published[-1][1]}")


# Hidden from Spark's readers by its first character.
_PUBLISHED = "_published"


def _at(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _published(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    files, path = _at(spark, f"{root}/{_PUBLISHED}")
    if not files.exists(path):
        files.mkdirs(path)
    names = [x.getPath().getName() for x in files.listStatus(path)]
    return sorted((int(n.split("-")[0]), n.split("-")[1]) for n in names)
