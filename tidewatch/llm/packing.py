"""Best-fit decreasing packing of documents into sequences of one length.

Overlong documents are cut into full windows first; every piece is then placed, longest first, in the
open sequence with the least room that still holds it, found by a segment tree over the room left.
Pieces of one length are alike to that rule, so it runs on the counts by length: at most
``capacity`` of them, however many documents there are. What it gives is a short list of runs ("pieces
of this length from this rank on go to sequences from that number on"), by which the tasks place
the pieces themselves. Ranks within a length come from counts of hash buckets, so a length that
a third of all pieces share still spreads over many tasks.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import texts, written
from tidewatch.llm.tokens import encoder, text_slices

CAPACITY = 2048
# Pieces per hash bucket, on average: bounds what one task ranks.
BUCKET_ROWS = 10_000
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Rooms:
    """Segment tree over room left: the number of open sequences, and the least room that suffices."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.width)

    def add(self, room: int, count: int) -> None:
        at = room + self.width
        while at:
            self.tree[at] += count
            at >>= 1

    def at_least(self, room: int) -> int | None:
        """The smallest room >= the one asked for that some open sequence has."""
        at = room + self.width
        if self.tree[at]:
            return room
        while at > 1 and (at & 1 or not self.tree[at + 1]):
            at >>= 1
        if at <= 1:
            return None
        at += 1
        while at < self.width:
            at = 2 * at if self.tree[2 * at] else 2 * at + 1
        return at - self.width


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, ...]]:
    """Runs (length, rank, pieces, pieces per sequence, first sequence, offset) for counts by length."""
    rooms, opened, runs, sequences = Rooms(capacity), defaultdict(list), [], 0

    def leave(room: int, first: int, count: int) -> None:
        if room and count:
            opened[room].append((first, count))
            rooms.add(room, count)

    for length in sorted((n for n in counts if n), reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = rooms.at_least(length)
            if room is None:  # all sequences that the rest needs, alike
                room, first, count = capacity, sequences, -(-left // (capacity // length))
                sequences += count
            else:
                first, count = opened[room].pop()
                rooms.add(room, -count)
            each = min(room // length, left)
            full = min(count, left // each)
            runs.append((length, rank, full * each, each, first, capacity - room))
            leave(room - each * length, first, full)
            leave(room, first + full, count - full)
            rank, left = rank + full * each, left - full * each
    return runs


def cut_pieces(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    capacity: int = CAPACITY,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Each document's ids plus ``end_id``, cut into windows of ``capacity`` and a rest."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in text_slices(batches):
            found = []
            for doc_id, ids in zip(
                batch.column("doc_id").to_pylist(), encode.encode(batch.column("text").to_pylist()), strict=True
            ):
                ids += end
                n = len(ids) // 4
                for at in range(0, n, capacity):
                    piece = ids[4 * at : 4 * (at + capacity)]
                    found.append((doc_id, at, len(piece) // 4, zlib.crc32(piece), n))
            yield pa.record_batch(
                [pa.array(c, pa.int64()) for c in zip(*found, strict=True)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    return texts(docs, id_column, text_column).mapInArrow(cut, PIECE_SCHEMA)


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``. They are read three times: give a stored table."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    buckets = max(64, sum(counts.values()) // BUCKET_ROWS)
    runs = np.array(best_fit_decreasing(counts, capacity), np.int64).reshape(-1, 6)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    starts = (runs[:, 0] << 44) + runs[:, 1]

    bucket = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int")
    dealt = pieces.withColumn("bucket", bucket)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")).select(
        "length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = dealt.withColumn("place", F.row_number().over(inside) - 1).join(bases, ["length", "bucket"])

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rank, length = f.pop("rank").to_numpy(), f["length"].to_numpy()
            run = runs[np.searchsorted(starts, (length << 44) + rank, "right") - 1]
            inner = rank - run[:, 1]
            yield f.assign(sequence_id=run[:, 4] + inner // run[:, 3], offset=run[:, 5] + inner % run[:, 3] * length)

    columns = [c.split(" ")[0] for c in PIECE_SCHEMA.split(", ")]
    return ranked.select(*columns, (F.col("base") + F.col("place")).cast("long").alias("rank")).mapInPandas(
        assign, PIECE_SCHEMA + ", sequence_id long, offset long"
    )


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, **columns: str) -> DataFrame:
    """Every piece of every document with the sequence that holds it and its offset there.

    A missing or empty text is one piece, the end id. Documents without an id, and repeated rows,
    are packed like any others. An empty table gives no pieces. Sequences count from 0 without gaps.
    """
    return place(written(cut_pieces(docs, tokenizer, end_id, capacity, **columns), "pieces"), capacity)
