"""Near-duplicate documents by SetSketch registers over word shingles.

A register is the smallest of a text's exponentially distributed shingle hashes, on a scale of exponent
steps and cut off at both ends: registers of a union are the larger of each, and equal registers are as
likely as two sets are similar. Bands of registers give buckets; pairs that share one are estimated by
the joint likelihood of greater, smaller and equal registers, and those that can be links are
confirmed on the full sets.

Texts with equal sets are one class from the start. In each bucket every class is first held against
one pivot, the class that meets most others; what that links becomes one component, so a large group of
near copies costs a star, not all its pairs. Buckets that still hold several components are then
compared across these, in pairs of blocks of bounded size: no link is lost, and only links leave a task.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import slices, texts, written

WORDS = 5
BANDS, ROWS = 28, 5
REGISTERS = BANDS * ROWS
BASE, RATE, LIMIT = 1.001, 20.0, (1 << 16) - 2  # scale step, rate of the exponential, cut-off
DEVIATIONS = 4.0  # an estimate this far below the threshold rules a pair out
BLOCK_BYTES = 8_000_000  # registers and sets on one side of a comparison
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    random = np.random.default_rng(8)
    odd = lambda n, bits: random.integers(0, 1 << bits, n, dtype=np.uint64) | np.uint64(1)
    return odd(256, 63), odd(WORDS, 63), odd(2 * REGISTERS, 32).astype(np.uint32).reshape(2, -1)


def shingle_sets(data: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles of each text as sorted 64-bit hashes, laid end to end, and each text's end."""
    byte_table, word_table, _ = _tables()
    flat = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    flat = flat + np.uint8(32) * ((flat >= 65) & (flat <= 90))
    space = (flat == 32) | ((flat >= 9) & (flat <= 13))
    solid = np.flatnonzero(~space)
    starts = np.flatnonzero(np.diff(solid, prepend=-2) > 1)
    edges = np.cumsum([len(d) + 1 for d in data])
    if not len(solid):
        return np.zeros(0, np.uint64), np.zeros(len(data), np.int64)
    inside = np.arange(len(solid)) - np.repeat(starts, np.diff(starts, append=len(solid)))
    powers = np.full(inside.max() + 1, np.uint64(0x9E3779B97F4A7C15))
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    word = _mix(np.add.reduceat(byte_table[flat[solid]] * powers[inside], starts))
    owner = np.searchsorted(edges, solid[starts], "right")
    count = np.bincount(owner, minlength=len(data))
    first = np.cumsum(count) - count
    padded = np.concatenate([word, np.zeros(words, np.uint64)])
    hashed = np.zeros(len(word), np.uint64)
    for k in range(words):
        hashed += padded[k : k + len(word)] * word_table[k]
    place = np.arange(len(word)) - first[owner]
    full = place <= count[owner] - words
    short = np.flatnonzero((count > 0) & (count < words))
    for i in short:  # the whole sequence as one
        own = word[first[i] : first[i] + count[i]]
        hashed[first[i]] = np.add.reduce(own * word_table[: len(own)]) + np.uint64(len(own))
        full[first[i]] = True
    hashed, owner = _mix(hashed[full]), owner[full]
    order = np.lexsort((hashed, owner))
    hashed, owner = hashed[order], owner[order]
    new = np.ones(len(hashed), bool)
    new[1:] = (hashed[1:] != hashed[:-1]) | (owner[1:] != owner[:-1])
    return hashed[new], np.cumsum(np.bincount(owner[new], minlength=len(data)))


def registers(hashed: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row of registers per text; a text without shingles has zeros."""
    _, _, (multiply, add) = _tables()
    sizes = np.diff(ends, prepend=0)
    out = np.zeros((len(ends), REGISTERS), np.uint16)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    starts, x = (ends - sizes)[some], (hashed >> np.uint64(32)).astype(np.uint32)
    y = np.empty_like(x)
    least = np.empty((len(some), REGISTERS), np.uint32)
    for k in range(REGISTERS):
        np.bitwise_xor(x, add[k], out=y)
        y *= multiply[k]
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        y ^= y >> np.uint32(13)
        least[:, k] = np.minimum.reduceat(y, starts)
    smallest = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    out[some] = np.clip(np.floor(1 - np.log(smallest) / np.log(BASE)), 0, LIMIT + 1)
    return out


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Likeliest Jaccard similarity of pairs, by greater, smaller and equal registers and the set sizes."""
    greater, smaller = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - greater - smaller
    u = size_a / (size_a + size_b)
    v = 1 - u
    most = np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)
    best, found = np.full(len(a), -np.inf), np.zeros(len(a))
    for share in np.linspace(0, 1, 101):
        j = share * most
        up, down = p(np.maximum(u - v * j, 1e-9)), p(np.maximum(v - u * j, 1e-9))
        fit = greater * np.log(up) + smaller * np.log(down) + equal * np.log(np.maximum(1 - up - down, 1e-9))
        found, best = np.where(fit > best, j, found), np.maximum(fit, best)
    return found


def _least_estimate(threshold: float) -> float:
    return threshold - DEVIATIONS * (threshold * (1 - threshold) / REGISTERS) ** 0.5


def sketch(docs: DataFrame) -> DataFrame:
    """Per row of (doc_id, text): text_hash, n_shingles, set_id (equal for equal sets, null for none), registers."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashed, ends = shingle_sets([t.encode() for t in batch.column("text").to_pylist()])
            rows, sizes = registers(hashed, ends), np.diff(ends, prepend=0)
            sets = [_set_id(hashed[e - n : e]) for e, n in zip(ends, sizes, strict=True)]
            yield pa.record_batch(
                [
                    *(batch.column(c) for c in ("doc_id", "text_hash")),
                    pa.array(sizes.astype("<i8")),
                    pa.array(sets, pa.int64()),
                    pa.array([r.tobytes() for r in rows], pa.binary()),
                ],
                names=["doc_id", "text_hash", "n_shingles", "set_id", "registers"],
            )

    named = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return named.mapInArrow(make, "doc_id long, text_hash long, n_shingles long, set_id long, registers binary")


def _set_id(hashed: np.ndarray) -> int | None:
    return xxhash.xxh3_64_intdigest(hashed.tobytes()) - (1 << 63) if len(hashed) else None


def bands(classes: DataFrame) -> DataFrame:
    """(bucket, band, set_id) of every class and band."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            rows = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16).reshape(-1, BANDS, ROWS)
            key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2]) + np.uint64(1)
            for k in range(ROWS):
                key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, k])
            ids = np.repeat(batch.column("set_id").to_numpy(), BANDS)
            band = np.tile(np.arange(BANDS, dtype=np.int32), len(rows))
            yield pa.record_batch([pa.array(key.ravel().view(np.int64)), pa.array(band), pa.array(ids)], names=["bucket", "band", "set_id"])

    return classes.select("set_id", "registers").mapInArrow(cut, "bucket long, band int, set_id long")


def likely(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (a, b) whose estimate allows a link."""
    side = lambda x: classes.select(
        F.col("set_id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}")
    )
    least = _least_estimate(threshold)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("r_a", "r_b"))
            ok = estimate(a, b, batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()) >= least
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    near = F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b")
    return pairs.join(side("a"), "a").join(side("b"), "b").where(near).mapInArrow(keep, "a long, b long")


def confirm(pairs: DataFrame, docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) with 100 * intersection >= percent * union, on the full sets."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data = batch.column("text").to_pylist()
            hashed, ends = shingle_sets([t.encode() for t in data])
            starts = np.concatenate([[0], ends[:-1]])
            sets = [_set_id(hashed[a:b]) for a, b in zip(starts, ends, strict=True)]
            yield pa.record_batch([pa.array(sets, pa.int64()), batch.column("text")], names=["set_id", "text"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            n = batch.num_rows
            both = [t.encode() for c in ("text_a", "text_b") for t in batch.column(c).to_pylist()]
            hashed, ends = shingle_sets(both)
            sizes = np.diff(ends, prepend=0)
            pair = np.repeat(np.arange(2 * n) % n, sizes)
            order = np.lexsort((hashed, pair))
            h, p = hashed[order], pair[order]
            shared = np.bincount(p[1:][(h[1:] == h[:-1]) & (p[1:] == p[:-1])], minlength=n)
            union = sizes[:n] + sizes[n:] - shared
            yield batch.select(["a", "b"]).filter(pa.array(100 * shared >= percent * union))

    needed = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    firsts = classes.join(needed, "set_id", "left_semi").select(F.col("rep").alias("doc_id")).distinct()
    found = written(docs.join(firsts, "doc_id", "left_semi").mapInArrow(own, "set_id long, text string"), "near-texts")
    found = found.dropDuplicates(["set_id"])
    side = lambda x: found.select(F.col("set_id").alias(x), F.col("text").alias(f"text_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(check, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(set_id, label) of every class with a link; the label is the smallest set_id reachable.

    Each round a class takes the smallest label among its neighbours and itself, then that label's own.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = written(both, "links")
    labels = written(
        edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("set_id"), F.least("a", "b").alias("label")), "labels"
    )
    while True:
        own, theirs = labels.withColumnRenamed("set_id", "a"), labels.select(F.col("set_id").alias("b"), F.col("label").alias("near"))
        near = edges.join(theirs, "b").groupBy("a").agg(F.min("near").alias("near"))
        step = own.join(near, "a").select(F.col("a").alias("set_id"), "label", F.least("label", "near").alias("to"))
        jump = labels.select(F.col("set_id").alias("to"), F.col("label").alias("further"))
        moved = written(
            step.join(jump, "to", "left").select(
                "set_id", F.least("to", F.coalesce("further", "to")).alias("label"), F.col("label").alias("before")
            ),
            "labels",
        )
        labels = moved.select("set_id", "label")
        if moved.where("label < before").isEmpty():
            return labels


def across(members: DataFrame, percent: int) -> DataFrame:
    """Links between different components among the rows of each bucket, each pair in its first common one.

    ``members`` has bucket, band, set_id, label, n_shingles, registers and the sorted set. A bucket is cut
    into blocks of about ``BLOCK_BYTES``; every pair of blocks is one unit. In a unit the likely pairs are
    confirmed on the sets, and those inside what is joined already are left out.
    """
    least = _least_estimate(percent / 100)
    size = F.octet_length("registers") + F.octet_length("set")
    sizes = members.groupBy("bucket").agg(F.ceil(F.sum(size) / BLOCK_BYTES).cast("int").alias("blocks"))
    dealt = members.join(sizes, "bucket").withColumn("own", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    units = dealt.withColumn("other", other).select(
        "bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        "band", "own", "set_id", "label", "n_shingles", "registers", "set",
    )

    def compare(group: pd.DataFrame) -> list[tuple[int, int]]:
        ids, label, n, own = (group[c].to_numpy() for c in ("set_id", "label", "n_shingles", "own"))
        if len(ids) < 2 or (label == label[0]).all():
            return []
        rows = np.frombuffer(b"".join(group["registers"]), np.uint16).reshape(-1, REGISTERS)
        sets = [np.frombuffer(x, np.uint64) for x in group["set"]]
        band, both_blocks = int(group["band"].iloc[0]), group["low"].iloc[0] != group["high"].iloc[0]
        roots: dict[int, int] = {}

        def root(x: int) -> int:
            while x in roots:
                x = roots[x]
            return x

        links = []
        for i in range(len(ids) - 1):
            j = np.arange(i + 1, len(ids))
            ok = (label[j] != label[i]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
            if both_blocks:
                ok &= own[j] != own[i]
            j = j[ok]
            same = rows[j] == rows[i]
            ok = same.sum(axis=1) >= (least - 0.05) * REGISTERS
            ok &= ~same[:, : band * ROWS].reshape(len(j), band, ROWS).all(axis=2).any(axis=1)  # met before
            j = j[ok]
            if len(j):
                j = j[estimate(np.broadcast_to(rows[i], (len(j), REGISTERS)), rows[j], np.full(len(j), n[i]), n[j]) >= least]
            for k in j:
                a, b = root(label[i]), root(label[k])
                if a != b:
                    place = np.minimum(np.searchsorted(sets[i], sets[k]), len(sets[i]) - 1)
                    shared = int((sets[i][place] == sets[k]).sum())
                    if 100 * shared >= percent * (n[i] + n[k] - shared):
                        roots[a] = b
                        links.append((ids[i], ids[k]))
        return links

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, rest = ["bucket", "low", "high"], None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            last = (frame[unit] == frame[unit].iloc[-1]).all(axis=1).to_numpy()
            rest = frame[last]
            yield pairs(frame[~last], unit)
        if rest is not None:
            yield pairs(rest, unit)

    def pairs(frame: pd.DataFrame, unit: list[str]) -> pd.DataFrame:
        found = [x for _, g in frame.groupby(unit, sort=False) for x in compare(g)]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    sorted_units = units.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    return sorted_units.mapInPandas(walk, "a long, b long").distinct()


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(set_id, set) of the wanted classes (set_id, rep): the sorted shingle hashes."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashed, ends = shingle_sets([t.encode() for t in batch.column("text").to_pylist()])
            own = np.split(hashed, ends[:-1])
            yield pa.record_batch(
                [pa.array([_set_id(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], names=["set_id", "set"]
            )

    reps = wanted.select(F.col("rep").alias("doc_id")).distinct()
    same = docs["doc_id"].eqNullSafe(reps["doc_id"])
    return docs.join(reps, same, "left_semi").mapInArrow(make, "set_id long, set binary").dropDuplicates(["set_id"])


def near_duplicates(
    docs: DataFrame, percent: int = 85, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Per row: doc_id, ``n_shingles``, ``component_id``, ``kept``, and for use
    with whole rows: ``text_hash`` (xxhash64 of the text) and ``group_id`` (null without words).

    Rows are linked when 100 * intersection >= percent * union of their shingle sets; ``component_id`` is the
    smallest doc_id reachable, ``kept`` says that it is the row's own. Texts without words, missing or
    empty ones, are linked with nothing. Rows with one doc_id are each taken by their text; a row without
    an id can link others, and has the smallest id of its group, or none. Other columns are ignored.
    """
    threshold = percent / 100
    rows = texts(docs, id_column, text_column)
    sketches = written(sketch(rows), "sketches")
    classes = written(
        sketches.where("set_id IS NOT NULL")
        .groupBy("set_id")
        .agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n_shingles"), F.max("registers").alias("registers")),
        "classes",
    )
    buckets = written(bands(classes), "buckets")
    # The pivot of a bucket is the class that meets most others over all its bands: often the original.
    crowded = written(buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "crowded")
    shared = written(buckets.join(crowded, "bucket"), "shared-buckets")
    met = shared.groupBy("set_id").agg(F.sum("n").alias("met"))
    central = F.max(F.struct("met", "set_id"))["set_id"].alias("a")
    pivots = shared.join(met, "set_id").groupBy("bucket").agg(central)
    spokes = shared.join(pivots, "bucket").where("set_id != a").select("a", F.col("set_id").alias("b")).distinct()
    stars = written(likely(spokes, classes, threshold), "stars")
    links = written(confirm(stars, rows, classes, percent), "star-links")

    labels = components(links)
    label = F.coalesce("label", "set_id")
    labelled = classes.join(labels, "set_id", "left").select("set_id", "rep", label.alias("label"), "n_shingles", "registers")
    tagged = shared.join(labelled.select("set_id", "label"), "set_id")
    mixed = tagged.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high")
    rest = written(tagged.join(mixed.select("bucket"), "bucket").select("bucket", "band", "set_id"), "mixed-buckets")
    wanted = labelled.join(rest.select("set_id").distinct(), "set_id", "left_semi")
    full = written(wanted.join(sets_of(rows, wanted), "set_id").drop("rep"), "sets")
    more = across(rest.join(full, "set_id"), percent)
    labels = components(written(links.union(more), "all-links"))

    named = classes.select("set_id", "rep").join(labels, "set_id", "left").select("set_id", "rep", label.alias("label"))
    smallest = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    names = named.join(smallest, "label").select("set_id", "component_id", F.col("label").alias("group_id"))
    out = sketches.select("doc_id", "text_hash", "n_shingles", "set_id").join(names, "set_id", "left")
    component = F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_hash", "group_id"
    )
