"""Dropping lines that many documents share, wherever they stand.

Two Bloom filters say which lines can repeat at all: a key enters the second when the first has it
already. Each task fills a pair for its own rows; pairs merge by OR, and what two first filters have in
common enters the second, so the merged second filter holds every key of two documents or more,
and only keys it holds leave their task, as SHA-256 digests. Those are counted exactly, and rows of very
frequent lines learn their count where they are. A filter's size
follows the bytes of text up to ``MOST_BITS``; a fuller filter lets more lines through to the count
and changes no result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import slices, written

BITS_PER_KEY = 8
MOST_BITS = 1 << 28  # 32 MB: what a task holds per filter, and what is broadcast
BLOCK = 1 << 10  # words of a filter that travel together
HOT_KEYS = 1 << 14  # lines that are broadcast, 40 bytes each: those with at least this part of all suspects


class BloomFilter:
    """64-bit words; a key sets four bits of one word."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def _place(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.zeros(len(keys), np.uint64)
        for shift in (0, 6, 12, 18):
            mask |= np.uint64(1) << ((keys >> np.uint64(shift)) & np.uint64(63))
        return ((keys >> np.uint64(24)) % np.uint64(len(self.words))).astype(np.int64), mask

    def add(self, keys: np.ndarray) -> None:
        at, mask = self._place(keys)
        np.bitwise_or.at(self.words, at, mask)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at, mask = self._place(keys)
        return (self.words[at] & mask) == mask


def line_keys(text: bytes, least: int) -> list[bytes]:
    """Keys of a text's lines: stripped of ASCII white space, A-Z lower-cased; b"" if under ``least`` code points."""
    keys = []
    for line in text.split(b"\n"):
        key = line.strip().lower()
        keys.append(key if len(key) >= least and len(key.decode("utf-8", "replace")) >= least else b"")
    return keys


def _hashes(text: bytes, least: int) -> dict[int, bytes]:
    """Each different key of a text by its 64-bit hash."""
    return {xxhash.xxh3_64_intdigest(k): k for k in line_keys(text, least) if k}


def twice_seen(docs: DataFrame, words: int, least: int, text_column: str = "text") -> np.ndarray:
    """The merged filter of keys that two rows or more hold (and a few more, by chance)."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = (BloomFilter(np.zeros(words, np.uint64)) for _ in range(2))
        for batch in slices(batches, 2000):
            keys = [h for t in batch.column(0).to_pylist() for h in _hashes(t, least)]
            found, count = np.unique(np.array(keys, np.uint64), return_counts=True)
            twice.add(found[(count > 1) | once.has(found)])
            once.add(found)
        rows = [
            (at // BLOCK, *(zlib.compress(f.words[at : at + BLOCK].tobytes(), 1) for f in (once, twice)))
            for at in range(0, words, BLOCK)
            if once.words[at : at + BLOCK].any()
        ]
        for at in range(0, len(rows), 500):
            columns = list(zip(*rows[at : at + 500], strict=True))
            yield pa.record_batch([pa.array(columns[0], pa.int32()), *map(pa.array, columns[1:])], names=["block", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for block, *pair in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                once, twice = (np.frombuffer(zlib.decompress(x), np.uint64) for x in pair)
                if block in merged:
                    have = merged[block]
                    have[1] |= twice | (have[0] & once)
                    have[0] |= once
                else:
                    merged[block] = [once.copy(), twice.copy()]
        for block, (_, twice) in merged.items():
            yield pa.record_batch([pa.array([block], pa.int32()), pa.array([twice.tobytes()])], names=["block", "twice"])

    parts = docs.select(F.coalesce(F.col(text_column), F.lit("")).cast("binary").alias("text")).mapInArrow(
        fill, "block int, once binary, twice binary"
    )
    out = np.zeros(words, np.uint64)
    for row in parts.repartition("block").mapInArrow(merge, "block int, twice binary").toLocalIterator():
        data = np.frombuffer(row["twice"], np.uint64)
        out[row["block"] * BLOCK : row["block"] * BLOCK + len(data)] = data
    return out


def filter_words(docs: DataFrame, least: int, text_column: str = "text") -> int:
    """Words of a filter: by the most keys that so many bytes can hold."""
    size = docs.select(F.sum(F.octet_length(text_column)).alias("n")).first()["n"] or 0
    bits = min(MOST_BITS, max(1 << 16, BITS_PER_KEY * size // (least + 1)))
    return 1 << (bits // 64 - 1).bit_length()


def dedup_lines(
    docs: DataFrame,
    least: int = 40,
    documents: int = 5,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``docs`` with repeated lines taken out of the text, and ``n_lines`` (before), ``n_dropped``.

    A line's key is the line without ASCII white space at both ends, A-Z lower-cased. A key of at
    least ``least`` code points that ``documents`` rows or more hold stays only in the rows with
    the largest id that holds it, with all its lines there. Each row counts as a document, repeated
    rows too; rows without an id rank below all others, and where none of a key's rows has an id, all
    keep it. A missing text becomes empty: one line. All other columns pass through; columns named
    ``n_lines`` or ``n_dropped`` are replaced.
    """
    spark = docs.sparkSession
    words = filter_words(docs, least, text_column)
    repeats = spark.sparkContext.broadcast(twice_seen(docs, words, least, text_column))

    def suspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = BloomFilter(repeats.value)
        for batch in slices(batches):
            found = [(i, h, k) for i, t in enumerate(batch.column("text").to_pylist()) for h, k in _hashes(t, least).items()]
            hit = seen.has(np.array([h for _, h, _ in found], np.uint64)) if found else []
            ids = batch.column("doc_id").to_pylist()
            rows = [(ids[i], hashlib.sha256(k).digest()) for (i, _, k), y in zip(found, hit, strict=True) if y]
            yield pa.record_batch(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
                names=["doc_id", "digest"],
            )

    text = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    suspects = written(
        docs.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("text")).mapInArrow(
            suspect, "doc_id long, digest binary"
        ),
        "suspects",
    )
    common = written(
        suspects.groupBy("digest")
        .agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
        .where((F.col("n") >= documents) & F.col("keeper").isNotNull()),
        "shared-lines",
    )
    # At most HOT_KEYS keys can hold so many of the rows each; they are broadcast, so no task gets all of one.
    many = -(-suspects.count() // HOT_KEYS)
    hot = F.broadcast(common.where(F.col("n") >= many).select("digest", "keeper"))
    found = suspects.join(hot, "digest", "left")
    other = common.where(F.col("n") < many).select("digest", "keeper").hint("merge")
    found = found.where("keeper IS NOT NULL").unionByName(found.where("keeper IS NULL").drop("keeper").join(other, "digest"))
    drops = (
        found.where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("doc_id").alias("_line_dedup_id"))
        .agg(F.collect_set("digest").alias("_line_dedup_drop"))
    )

    @F.arrow_udf("struct<text: string, n_lines: long, n_dropped: long>")
    def without(text: pa.Array, drop: pa.Array) -> pa.Array:
        out = []
        for t, d in zip(text.to_pylist(), drop.to_pylist(), strict=True):
            n, dropped = t.count(b"\n") + 1, 0
            if d:
                gone, kept = set(d), []
                for line, key in zip(t.split(b"\n"), line_keys(t, least), strict=True):
                    if not key or hashlib.sha256(key).digest() not in gone:
                        kept.append(line)
                dropped, t = n - len(kept), b"\n".join(kept)
            out.append((t, n, dropped))
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.StructArray.from_arrays(
            [pa.array(columns[0], pa.binary()).cast(pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])],
            ["text", "n_lines", "n_dropped"],
        )

    joined = docs.join(drops, F.col(id_column).cast("long").eqNullSafe(F.col("_line_dedup_id")), "left")
    done = joined.withColumn("_line_dedup", without(text, F.col("_line_dedup_drop")))
    others = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return done.select(
        *[F.col("_line_dedup.text").alias(c) if c == text_column else F.col(c) for c in others],
        F.col("_line_dedup.n_lines"),
        F.col("_line_dedup.n_dropped"),
    )
