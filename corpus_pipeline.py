"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept. All but the last return
the columns they were given. A row is told by its id and its text, so rows without an id and rows
that share one are decided each by its own text; other columns are carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import table, written
from tidewatch.llm.containment import contaminated
from tidewatch.llm.line_dedup import dedup_lines
from tidewatch.llm.packing import pack
from tidewatch.llm.quality import classify
from tidewatch.llm.setsketch import near_duplicates

SIMILAR_PERCENT = 80
KEY = ["_row_id", "_row_hash"]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns(
        {
            "_row_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))),
            "_row_hash": F.xxhash64(F.coalesce(F.col("text"), F.lit(""))),
        }
    )


def _keys(found: DataFrame, text_hash: str) -> DataFrame:
    """The keys of the rows an operator names by doc_id and the text's hash, each once.

    They grow with the corpus, so the plan is the same at every size: a merge, never a broadcast.
    """
    row_id = F.coalesce("doc_id", F.lit(-(2**63)))
    return found.select(row_id.alias("_row_id"), F.col(text_hash).alias("_row_hash")).distinct().hint("merge")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose perplexity is above their language's limit; repeated rows share their fate."""
    judged = classify(docs, table(spark, sf_dir, "labels"))
    rejected = _keys(judged.where(~F.col("kept")), "row")
    return _keyed(docs).join(rejected, KEY, "left_anti").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that five or more documents share; ``n_chars`` follows the text."""
    done = dedup_lines(docs)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return done.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id; texts without words all stay.

    Of rows with the same id and text one stays, also where they have no words.
    """
    kept = near_duplicates(docs, SIMILAR_PERCENT).where("kept").select("doc_id", "text_hash", "group_id")
    alone = kept.where("group_id IS NULL").select("doc_id", "text_hash")
    first = kept.where("group_id IS NOT NULL").groupBy("group_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("r")).select("r.*")
    keys = _keys(alone.union(first), "text_hash")
    return _keyed(docs).join(keys, KEY, "left_semi").dropDuplicates(KEY).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    found = contaminated(docs, table(spark, sf_dir, "benchmark"))
    return _keyed(docs).join(_keys(found, "text_hash"), KEY, "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, packed into sequences."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1)


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL has no tokenizer and no language model; the tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
