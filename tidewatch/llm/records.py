"""Token ids in length-delimited binary files with checksums, and an offset index beside them.

A file starts with ``MAGIC`` and the bytes per id (2 where the vocabulary fits, else 4). Each record
is: the payload's length (u64), that field's masked checksum (u32), the payload (the ids),
the payload's masked checksum (u32); all little-endian. The checksum is CRC-32, rotated by 15 bits
plus a constant, so that a checksum stored among data does not disturb the outer one. The index is a
Parquet table of (part, file, row, doc_id, position, n_tokens, local_start), so a reader can fetch
any record in any order.

Files are written by the tasks, straight to the folder given, under names that hold the task
attempt. Only the index, committed by Spark, says which files count: a lost or repeated attempt
leaves at most an unlisted file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import slices, texts
from tidewatch.llm.tokens import encoder, text_slices

MAGIC = b"TWREC1"
MASK = 0xA282EAD8  # added to the rotated checksum
INDEX_SCHEMA = (
    "part int, file string, row long, doc_id long, position long, n_tokens long, local_start long"
)
_HEAD = struct.Struct("<QI")
_TAIL = struct.Struct("<I")


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + _TAIL.pack(masked(length)) + payload + _TAIL.pack(masked(payload))


def unframe(source, position: int) -> bytes:
    """The payload of the record at a position of an open file; fails if a checksum differs."""
    source.seek(position)
    head = source.read(_HEAD.size)
    length, check = _HEAD.unpack(head)
    if masked(head[:8]) != check:
        raise ValueError(f"damaged length at {position}")
    data = source.read(length + _TAIL.size)
    if len(data) != length + _TAIL.size or masked(data[:-4]) != _TAIL.unpack(data[-4:])[0]:
        raise ValueError(f"damaged record at {position}")
    return data[:-4]


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its scheme, as Spark's own file system reads it: executors may have another default."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def write_records(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Encode every text, append ``end_id``, write record files and the index; returns the index.

    Documents stand in ascending id order over the files, those without an id first, repeated ids by
    text. A missing or empty text is a record with the end id alone; an empty table gives an empty
    index. Other columns of ``docs`` are ignored. ``folder`` must be new and reachable from everywhere.
    """
    spark = docs.sparkSession
    folder = qualified(spark, folder)
    tie = F.xxhash64("text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(tokenizer), TaskContext.get()
        width = "<u2" if max(encode.size, end_id + 1) <= 1 << 16 else "<u4"
        store, root = _store(folder)
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.rec"
        out, position, row, start = None, 0, 0, 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in text_slices(batches):
            if out is None:
                store.create_dir(f"{root}/data")
                out = store.open_output_stream(f"{root}/data/{name}")
                head = MAGIC + bytes([np.dtype(width).itemsize])
                out.write(head)
                position = len(head)
            found = []
            for doc_id, ids in zip(
                batch.column("doc_id").to_pylist(), encode.encode(batch.column("text").to_pylist()), strict=True
            ):
                payload = np.frombuffer(ids + end, "<u4").astype(width).tobytes()
                record = frame(payload)
                out.write(record)
                n = len(ids) // 4 + 1
                found.append((task.partitionId(), f"data/{name}", row, doc_id, position, n, start))
                position, row, start = position + len(record), row + 1, start + n
            columns = list(zip(*found, strict=True))
            yield pa.record_batch(
                [pa.array(columns[0], pa.int32()), pa.array(columns[1]), *(pa.array(c, pa.int64()) for c in columns[2:])],
                names=["part", "file", "row", "doc_id", "position", "n_tokens", "local_start"],
            )
        if out is not None:
            out.close()

    rows = texts(docs, id_column, text_column)
    ordered = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "text")
    ordered.mapInArrow(write, INDEX_SCHEMA).write.parquet(f"{folder}/index")
    return read_index(spark, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index with ``start``, the ids of all documents before; one small row per file is summed up."""
    index = spark.read.schema(INDEX_SCHEMA).parquet(f"{folder}/index")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return index.join(F.broadcast(bases), "part").select(
        *index.columns, (F.col("base") + F.col("local_start")).alias("start")
    )


def _payloads(index: DataFrame, folder: str, make, schema: str) -> DataFrame:
    """``make(index rows, ids of each)`` on the records of the index rows, read and verified by the tasks."""

    folder = qualified(index.sparkSession, folder)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        name, source, width = None, None, "<u4"
        for batch in slices(batches):
            ids = []
            for file, position in zip(
                batch.column("file").to_pylist(), batch.column("position").to_pylist(), strict=True
            ):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, store.open_input_file(f"{root}/{file}")
                    head = source.read(len(MAGIC) + 1)
                    if head[:-1] != MAGIC:
                        raise ValueError(f"not a record file: {file}")
                    width = f"<u{head[-1]}"
                ids.append(np.frombuffer(unframe(source, position), width))
            yield make(batch, ids)
        if source is not None:
            source.close()

    return index.select("doc_id", "start", "file", "position").mapInArrow(read, schema)


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """One row per index row, in whatever order they come: doc_id, start, and the ids read back."""

    def make(batch: pa.RecordBatch, ids: list[np.ndarray]) -> pa.RecordBatch:
        flat = pa.array(np.concatenate(ids).astype("<i8"))
        ends = np.cumsum([0, *map(len, ids)]).astype("<i4")
        lists = pa.ListArray.from_arrays(pa.array(ends), flat)
        return pa.record_batch([batch.column("doc_id"), batch.column("start"), lists], names=["doc_id", "start", "ids"])

    return _payloads(index, folder, make, "doc_id long, start long, ids array<long>")


def read_digests(index: DataFrame, folder: str) -> DataFrame:
    """Per record read back: doc_id, start, n_tokens and the crc32 of its ids as u32 little-endian."""

    def make(batch: pa.RecordBatch, ids: list[np.ndarray]) -> pa.RecordBatch:
        sizes = pa.array([len(x) for x in ids], pa.int64())
        crc = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())
        return pa.record_batch(
            [batch.column("doc_id"), batch.column("start"), sizes, crc], names=["doc_id", "start", "n_tokens", "ids_crc32"]
        )

    return _payloads(index, folder, make, "doc_id long, start long, n_tokens long, ids_crc32 long")
