"""The registered query of each text operator: production parameters, whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.centroids import cluster, described
from tidewatch.llm.common import held_out, table
from tidewatch.llm.containment import contaminated
from tidewatch.llm.html_text import extract_text
from tidewatch.llm.infill import digests, infill, stored
from tidewatch.llm.language_id import identify
from tidewatch.llm.line_dedup import dedup_lines
from tidewatch.llm.mixing import sample
from tidewatch.llm.packing import pack
from tidewatch.llm.quality import classify
from tidewatch.llm.records import read_digests, write_records
from tidewatch.llm.setsketch import near_duplicates
from tidewatch.llm.toxicity import score_toxicity
from tidewatch.llm.vectors import nearest
from tidewatch.session import run_folder


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that five or more of them share."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors found for every fiftieth vector."""
    return nearest(table(spark, sf_dir, "embeddings"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document under the trusted ones, and whether it is kept."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("row")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from two thirds of them."""
    return identify(table(spark, sf_dir, "documents"), ~held_out("doc_id"))


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as token ids in record files, digested from those files."""
    folder = run_folder(spark, "records")
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    index = write_records(table(spark, sf_dir, "documents"), folder, tokenizer, end_id=2)
    return read_digests(index, folder)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document, learnt from the labels of two thirds of them."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score_toxicity(docs, labels, ~held_out("doc_id"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least four fifths of a benchmark item's shingles, with the item."""
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose word shingles agree to 85 percent."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash", "group_id")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into sequences of 2048 tokens."""
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return pack(table(spark, sf_dir, "documents"), tokenizer, end_id=1)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_text(table(spark, sf_dir, "pages"))


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as fill-in-middle samples, digested from their frames, with the texts rebuilt from them."""
    return digests(infill(stored(table(spark, sf_dir, "documents")), seed=1))


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster after ten rounds, with the sums of squared distances."""
    return described(*cluster(table(spark, sf_dir, "embeddings")))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix of sources takes each document."""
    return sample(table(spark, sf_dir, "documents"), seed=13).drop("source", "row")


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_neighbours": op2_neighbours,
    "op3_quality": op3_quality,
    "op4_language_id": op4_language_id,
    "op5_token_records": op5_token_records,
    "op6_toxicity": op6_toxicity,
    "op7_decontamination": op7_decontamination,
    "op8_near_dedup": op8_near_dedup,
    "op9_packing": op9_packing,
    "op10_html_text": op10_html_text,
    "op11_infill": op11_infill,
    "op12_clusters": op12_clusters,
    "op13_mixing": op13_mixing,
}
