"""Missing cells and repeated rows per batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.schema import BATCH_COLUMN, TAG_COLUMNS, MonitorConfig


def original_columns(df: DataFrame, batch: str = BATCH_COLUMN) -> list[str]:
    return [c for c in df.columns if c not in {*TAG_COLUMNS, batch}]


def row_digest(df: DataFrame, columns: list[str]) -> Column:
    """SHA-256 of the whole row as 32 bytes.

    The row is written as JSON first: quoted text and absent NULL fields make the
    encoding one-to-one. Timestamps are cast because JSON would drop microseconds,
    and adding zero makes -0.0 and 0.0 one value, as grouping does.
    """
    types = {f.name: f.dataType.typeName() for f in df.schema.fields}

    def cell(c):
        if types[c] in ("double", "float"):
            return F.col(c) + F.lit(0.0)
        return F.col(c).cast("string") if types[c].startswith("timestamp") else F.col(c)

    fields = [cell(c).alias(str(i)) for i, c in enumerate(columns)]
    return F.unhex(F.sha2(F.to_json(F.struct(*fields)), 256))


def missing_cells(df: DataFrame, columns: list[str]) -> Column:
    """NULL and, in floating columns, NaN."""
    floating = {c for c, t in df.dtypes if t in ("double", "float")}
    missing = (F.col(c).isNull() | F.isnan(c) if c in floating else F.col(c).isNull() for c in columns)
    return sum((m.cast("int") for m in missing), F.lit(0))


def digest_counts(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Copies and missing cells per key and row digest; tables of these counts can be added up.

    Only (key, digest, two counters) is shuffled instead of whole rows, and copies
    of one row meet map-side first, so a heavily repeated row is no hot spot.
    """
    return (
        df.select(*keys, row_digest(df, columns).alias("_digest"), missing_cells(df, columns).alias("_missing"))
        .groupBy(*keys, "_digest")
        .agg(F.count("*").alias("copies"), F.sum("_missing").alias("missing"))
    )


def quality_counts(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows, missing cells and duplicate rows per key in one pass and one shuffle."""
    return counted_digests(digest_counts(df, keys, columns), keys)


def counted_digests(per_row: DataFrame, keys: list[str]) -> DataFrame:
    return per_row.groupBy(*keys).agg(
        F.sum("copies").alias("rows"),
        F.sum("missing").alias("missing_cells"),
        F.sum(F.col("copies") - 1).alias("duplicate_rows"),
    )


def duplicate_rows(df: DataFrame, keys=(BATCH_COLUMN,), columns: list[str] | None = None) -> DataFrame:
    columns = columns or original_columns(df)
    return quality_counts(df, list(keys), columns).select(*keys, "duplicate_rows")


def missing_share(df: DataFrame, keys=(BATCH_COLUMN,), columns: list[str] | None = None) -> DataFrame:
    """Missing cells / all cells; needs no row comparison, hence no wide shuffle."""
    columns = columns or original_columns(df)
    return df.groupBy(*keys).agg(
        (F.sum(missing_cells(df, columns)) / (F.count("*") * len(columns))).alias("missing_percentage")
    )


def data_quality(
    df: DataFrame,
    keys=(BATCH_COLUMN,),
    columns: list[str] | None = None,
    config: MonitorConfig = MonitorConfig(),
) -> DataFrame:
    """Missing share over all original columns, extra copies of full rows, and the flag."""
    columns = columns or original_columns(df)
    return quality_flags(quality_counts(df, list(keys), columns), list(keys), len(columns), config)


def quality_flags(counts: DataFrame, keys: list[str], columns: int, config: MonitorConfig = MonitorConfig()) -> DataFrame:
    """Shares and the flag from rows, missing cells and duplicates of tables with so many columns."""
    share = F.col("missing_cells") / (F.col("rows") * columns)
    return counts.select(
        *keys,
        share.alias("missing_percentage"),
        "duplicate_rows",
        ((share >= config.missing_threshold) | (F.col("duplicate_rows") > 0)).alias(
            "data_quality_issue_detected"
        ),
    )
