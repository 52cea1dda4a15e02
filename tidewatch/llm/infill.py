"""Fill-in-middle documents from texts kept as seekable compressed frames.

A text is stored as independent zstandard frames, each with the number of code points up to its end. To move
pieces of a text only the frames that hold a cut are opened; all others go to the output as they stand.
Digests read a document's frames in order, one at a time, and so does the way back from an output to its text.
"""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import slices, written

FRAME_BYTES = 65_536
LEVEL = 3
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
# Which segments follow their marks, in each form.
ORDER = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
PLAIN_FROM = 90  # of a hundred: the rest stays plain
SPM_BELOW = 20  # of a hundred others

_FRAMES = "array<struct<until: bigint, data: binary>>"
STORE_SCHEMA = f"doc_id long, units long, marked boolean, frames {_FRAMES}"
OUTPUT_SCHEMA = f"doc_id long, n long, form string, prefix_chars long, middle_chars long, output {_FRAMES}"
DIGEST_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
_ARROW_FRAMES = pa.list_(pa.struct([("until", pa.int64()), ("data", pa.binary())]))

Frame = tuple[int, bytes]  # code points up to its end, compressed bytes


@lru_cache(maxsize=1)
def _zstd():
    return zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()


def shut(data: bytes) -> bytes:
    return _zstd()[0].compress(data)


def opened(frame: bytes) -> bytes:
    return _zstd()[1].decompress(frame)


def _leads(data: bytes) -> np.ndarray:
    """Where code points begin."""
    return np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)


def units(data: bytes) -> int:
    return len(data) if data.isascii() else len(_leads(data))


def frames_of(text: bytes, size: int = FRAME_BYTES) -> list[Frame]:
    """Frames of at most ``size`` bytes (four or more), never cut inside a code point."""
    found, at, until = [], 0, 0
    while at < len(text):
        end = min(at + max(size, 4), len(text))
        back = next((k for k in range(4) if end == len(text) or text[end - k] & 0xC0 != 0x80), 0)  # damaged text: cut anywhere
        end -= back
        piece = text[at:end]
        until += units(piece)
        found.append((until, shut(piece)))
        at = end
    return found


def cut(frames: list[Frame], *at: int) -> list[list[Frame]]:
    """The frames between cuts in ascending order, ``until`` as in the whole; only those that hold a cut are opened."""
    parts, ends, k, start = [], [u for u, _ in frames], 0, 0
    rest: bytes | None = None  # what is left of frame k after the last cut
    for point in at:
        part = []
        last = bisect_right(ends, point)  # frames before it end at or before the cut
        while k < last:
            part.append(frames[k] if rest is None else (ends[k], shut(rest)))
            rest, start, k = None, ends[k], k + 1
        if point > start:
            data = opened(frames[k][1]) if rest is None else rest
            inside = point - start
            byte = inside if data.isascii() else int(_leads(data)[inside])
            part.append((point, shut(data[:byte])))
            rest, start = data[byte:], point
        parts.append(part)
    tail = [] if rest is None else [(ends[k], shut(rest))]
    parts.append(tail + frames[k + len(tail) :])
    return parts


@lru_cache(maxsize=8)
def _mark(name: bytes) -> bytes:
    return shut(name)


def arrange(form: str, parts: dict[bytes, list[Frame]], starts: dict[bytes, int]) -> list[Frame]:
    """Marks and segments in the form's order, code points counted anew."""
    found, until = [], 0
    for mark in ORDER[form]:
        until += len(mark)
        found.append((until, _mark(mark)))
        base, first = until, starts[mark]
        for end, data in parts[mark]:
            until = base + end - first
            found.append((until, data))
    return found


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four numbers below 2^32 from the seed and the id (none: as an empty one)."""
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    return struct.unpack(">4I", hashlib.sha256(name.encode()).digest()[:16])


def transform(doc_id: int | None, n: int, marked: bool, frames: list[Frame], seed: int):
    """form, prefix and middle in code points (none if plain), and the output's frames."""
    h1, h2, h3, h4 = draws(seed, doc_id)
    if n == 0 or marked or h3 % 100 >= PLAIN_FROM:
        return "plain", None, None, frames
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    form = "spm" if h4 % 100 < SPM_BELOW else "psm"
    prefix, middle, suffix = cut(frames, a, b)
    parts = {PREFIX: prefix, MIDDLE: middle, SUFFIX: suffix}
    return form, a, b - a, arrange(form, parts, {PREFIX: 0, MIDDLE: a, SUFFIX: b})


def _places(chunks: Iterable[bytes], marks: tuple[bytes, ...]) -> tuple[list[int], list[int]]:
    """Bytes at which each mark begins, looked for one after the other, and bytes up to each chunk's end."""
    found, ends, carry, at = [], [], b"", 0
    for chunk in chunks:
        window, base, begin = carry + chunk, at - len(carry), 0
        while len(found) < len(marks) and (hit := window.find(marks[len(found)], begin)) >= 0:
            begin = hit + len(marks[len(found)])
            found.append(base + hit)
        at += len(chunk)
        ends.append(at)
        # A mark may go on in the next chunk; what a found one took does not count again.
        carry = window[max(begin, len(window) - len(PREFIX) + 1) :]
    return found, ends


def restored(form: str, frames: list[bytes]) -> Iterator[bytes]:
    """The text behind an output, piece by piece: its segments are found by their marks and put in order."""
    if form == "plain":
        yield from map(opened, frames)
        return
    marks = ORDER[form]
    places, ends = _places(map(opened, frames), marks)
    if len(places) != len(marks):
        raise ValueError("an output without all its marks")
    stops = [*places[1:], ends[-1]]
    spans = {m: (p + len(m), s) for m, p, s in zip(marks, places, stops, strict=True)}
    for mark in (PREFIX, MIDDLE, SUFFIX):
        first, stop = spans[mark]
        k = bisect_right(ends, first)
        while first < stop:
            data = opened(frames[k])
            begin = ends[k] - len(data)
            yield data[first - begin : stop - begin]
            first, k = ends[k], k + 1


def frame_store(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = FRAME_BYTES) -> DataFrame:
    """One row per document: its code points, whether it holds a mark, and its frames. A missing text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = []
            for text in batch.column("text"):
                text = text.as_buffer().to_pybytes()
                frames = frames_of(text, size)
                found.append((frames[-1][0] if frames else 0, any(m in text for m in (PREFIX, SUFFIX, MIDDLE)), frames))
            counts, marked, frames = zip(*found, strict=True) if found else ((), (), ())
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(marked, pa.bool_()), _listed(frames)],
                names=["doc_id", "units", "marked", "frames"],
            )

    text = F.coalesce(F.col(text_column).cast("binary"), F.lit(b""))
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, STORE_SCHEMA)


def infill(store: DataFrame, seed: int) -> DataFrame:
    """Every stored document in its form: n (code points), form, prefix_chars, middle_chars, and ``output`` in frames.

    psm is prefix, suffix, middle behind their marks, spm is suffix, prefix, middle. Where the text is
    empty or holds a mark itself, and by the hash of seed and id for a tenth of the others, the output is the
    text and the counts are null. Rows without an id are drawn as if it were empty; repeated rows come out alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "units", "marked"))
            found = [
                (n, *transform(doc_id, n, marked, frames, seed))
                for doc_id, n, marked, frames in zip(*columns, _lists(batch.column("frames")), strict=True)
            ]
            n, form, prefix, middle, output = zip(*found, strict=True) if found else ((), (), (), (), ())
            counts = [pa.array(c, pa.int64()) for c in (n, prefix, middle)]
            yield pa.record_batch(
                [batch.column("doc_id"), counts[0], pa.array(form, pa.string()), counts[1], counts[2], _listed(output)],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return store.mapInArrow(run, OUTPUT_SCHEMA)


def texts_of(outputs: DataFrame) -> DataFrame:
    """The outputs as texts, for those who want them whole: the columns of ``infill``, ``output`` as a string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            whole = [b"".join(opened(d) for _, d in frames) for frames in _lists(batch.column("output"))]
            rest = [batch.column(c) for c in batch.schema.names if c != "output"]
            yield pa.record_batch([*rest, pa.array(whole, pa.binary())], names=[c for c in batch.schema.names if c != "output"] + ["output"])

    schema = OUTPUT_SCHEMA.replace(f"output {_FRAMES}", "output binary")
    return outputs.mapInArrow(run, schema).withColumn("output", F.col("output").cast("string"))


def digests(outputs: DataFrame) -> DataFrame:
    """SHA-256 of each output, and of the text rebuilt from it, its frames read in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = []
            for form, frames in zip(batch.column("form").to_pylist(), _lists(batch.column("output")), strict=True):
                data = [d for _, d in frames]
                found.append((_digest(map(opened, data)), _digest(restored(form, data))))
            output, text = zip(*found, strict=True) if found else ((), ())
            rest = [batch.column(c) for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars")]
            yield pa.record_batch([*rest, pa.array(output, pa.string()), pa.array(text, pa.string())], names=_names(DIGEST_SCHEMA))

    return outputs.mapInArrow(run, DIGEST_SCHEMA)


def _digest(chunks: Iterable[bytes]) -> str:
    sha = hashlib.sha256()
    for chunk in chunks:
        sha.update(chunk)
    return sha.hexdigest()


def _names(schema: str) -> list[str]:
    return [c.split(" ")[0] for c in schema.split(", ")]


def _listed(rows: Iterable[list[Frame]]) -> pa.Array:
    rows = list(rows)
    offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    until = pa.array([u for r in rows for u, _ in r], pa.int64())
    data = pa.array([d for r in rows for _, d in r], pa.binary())
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([until, data], ["until", "data"]), type=_ARROW_FRAMES)


def _lists(column: pa.Array) -> Iterator[list[Frame]]:
    flat, sizes = column.flatten(), column.value_lengths().to_pylist()
    until, data = flat.field("until").to_pylist(), flat.field("data")
    at = 0
    for n in sizes:
        yield [(until[i], data[i].as_buffer().to_pybytes()) for i in range(at, at + n)]
        at += n


def stored(docs: DataFrame, **columns: str) -> DataFrame:
    """``frame_store`` as a table in the shared folder, to be read as often as there are seeds."""
    return written(frame_store(docs, **columns), "frames")
