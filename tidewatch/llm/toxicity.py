"""Toxic texts by a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

A text's features are the different n-grams of its lower-cased letters, as 62-bit keys. The weights are a
logistic regression with a quadratic penalty, fitted to a sample of at most about ``FIT_ROWS`` labelled rows
of each class; a feature that no row of the sample has would keep the weight 0, so the sample's features are
the vocabulary, whatever the size of the corpus, and no two share an entry. Each is scaled by the log of how
much larger its share of toxic rows' features is than its share of the other rows'; these counts are of
every learnable row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import slices, written
from tidewatch.llm.grams import hashes, letters, segments, spread_bits

ORDERS = (4, 5, 6)
KEY_BITS = 62
# Added to a feature's counts, shared out over the classes by their size, so that rare features lean to neither.
SMOOTHING = 40.0
# Features that say less than this either way get no weight.
LEAST_RATIO = 0.7
# The bound of the sample that the weights are fitted to: this many rows of either class, expected.
FIT_ROWS = 3_000
PENALTY = 1.0
STEPS = 150
TOXIC_FROM = 0.7
_BLOCK = 1 << 14


class Vocabulary:
    """Different keys, numbered in ascending order, found through tables that each hold what the one before had no room for."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.levels: list[tuple[int, np.uint64, np.ndarray]] = []
        left = np.arange(len(keys), dtype=np.int32)
        while len(left):
            bits = max(10, (8 * len(left)).bit_length())
            odd = np.uint64((0x9E3779B97F4A7C15 * (2 * len(self.levels) + 1)) & (2**64 - 1))
            slots, table = self._slots(keys[left], bits, odd), np.full(1 << bits, -1, np.int32)
            table[slots] = left
            self.levels.append((bits, odd, table))
            left = left[table[slots] != left]

    @staticmethod
    def _slots(keys: np.ndarray, bits: int, odd: np.uint64) -> np.ndarray:
        return ((keys.astype(np.uint64) * odd) >> np.uint64(64 - bits)).astype(np.int64)

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's number, -1 where the vocabulary lacks it."""
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for bits, odd, table in self.levels:
            at = table[self._slots(keys[todo], bits, odd)]
            taken = at >= 0  # an empty place: no key of the vocabulary comes here
            todo, at = todo[taken], at[taken]
            same = self.keys[at] == keys[todo]
            out[todo[same]] = at[same]
            todo = todo[~same]
        return out


def _scan(texts: list[str]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """For stretches of the texts: the text of each position, and the key of the feature that ends there, per order."""
    edge = np.full(1, 32, np.uint32)
    points = [np.concatenate([edge, p, edge]) if len(p) else p for p in map(letters, texts)]
    for flat, at, which in segments(points, max(ORDERS)):
        h = hashes(flat, max(ORDERS))
        yield which, [spread_bits(h[k][at] + np.uint64(k), KEY_BITS) for k in ORDERS]


def features(texts: list[str]) -> list[np.ndarray]:
    """The different features of each text, as sorted keys."""
    found: list[list[np.ndarray]] = [[] for _ in texts]
    for which, own in _scan(texts):
        starts = np.flatnonzero(np.diff(which, prepend=-1))
        for i, a, b in zip(which[starts], starts, [*starts[1:], len(which)], strict=True):
            found[i].append(np.unique(np.concatenate([f[a:b] for f in own])))
    return [np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64) for parts in found]


def known(texts: list[str], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Text and number of each text's features in the vocabulary, each feature once."""
    size, pairs = max(len(vocabulary), 1), [np.zeros(0, np.int64)]
    for which, own in _scan(texts):
        for f in own:
            at = vocabulary.find(f)
            some = np.flatnonzero(at >= 0)
            pairs.append(np.unique(which[some] * size + at[some]))
    return np.divmod(np.unique(np.concatenate(pairs)), size)


def margins(texts: list[str], vocabulary: Vocabulary, weights: np.ndarray) -> np.ndarray:
    """The sum of each text's features' weights, each feature once."""
    which, at = known(texts, vocabulary)
    return np.bincount(which, weights[at], minlength=len(texts))


def find_vocabulary(sample: DataFrame) -> Vocabulary:
    """The features of the sample's texts; as its size is bounded, so is theirs."""

    def chunks(keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(keys), 1 << 20):
            yield pa.record_batch([pa.array([keys[at : at + (1 << 20)].tobytes()])], names=["keys"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = np.zeros(0, np.int64)
        for batch in slices(batches, 64):
            keys = np.unique(np.concatenate([keys, *features(batch.column("text").to_pylist())]))
        yield from chunks(keys)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = np.zeros(0, np.int64)
        for batch in batches:
            for x in batch.column("keys").to_pylist():
                keys = np.union1d(keys, np.frombuffer(x, "<i8"))
        yield from chunks(keys)

    parts = sample.select("text").mapInArrow(listed, "keys binary").repartition(1).mapInArrow(merge, "keys binary").collect()
    keys = [np.frombuffer(r["keys"], "<i8") for r in parts]
    return Vocabulary(np.sort(np.concatenate([np.zeros(0, np.int64), *keys])))


def count_features(rows: DataFrame, vocabulary) -> DataFrame:
    """One pass over (text, toxic): partial counts by class and block of the (broadcast) vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(vocabulary.value)
        sums = np.zeros((2, size), np.int64)
        for batch in slices(batches, 64):
            toxic = np.array(batch.column("toxic").to_pylist(), np.int64)
            which, at = known(batch.column("text").to_pylist(), vocabulary.value)
            for label in (0, 1):
                sums[label] += np.bincount(at[toxic[which] == label], minlength=size)
        for label in (0, 1):
            blocks = [b for b in range(0, size, _BLOCK) if sums[label, b : b + _BLOCK].any()]
            yield _rows(
                np.array([b // _BLOCK for b in blocks], np.int64),
                [label] * len(blocks),
                [zlib.compress(sums[label, b : b + _BLOCK].astype("<i8").tobytes(), 1) for b in blocks],
            )

    return rows.mapInArrow(count, "block int, toxic int, data binary")


def _rows(block: np.ndarray, toxic: list[int], data: list[bytes]) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array(block, pa.int32()), pa.array(toxic, pa.int32()), pa.array(data, pa.binary())], names=["block", "toxic", "data"]
    )


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for block, toxic, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            part = np.frombuffer(zlib.decompress(data), "<i8")
            sums[block, toxic] = sums[block, toxic] + part if (block, toxic) in sums else part
    for (block, toxic), total in sums.items():
        yield _rows(np.array([block]), [toxic], [total.tobytes()])


def ratios(parts: DataFrame, size: int) -> np.ndarray:
    """Log-count ratio of every feature; the counts that reach the driver are two per feature of the vocabulary."""
    sums = np.zeros((2, size))
    merged = parts.repartition("block", "toxic").mapInArrow(_merge, parts.schema)
    for row in merged.toLocalIterator():
        part = np.frombuffer(row["data"], "<i8")
        sums[row["toxic"], row["block"] * _BLOCK : row["block"] * _BLOCK + len(part)] += part
    totals = np.maximum(sums.sum(axis=1), 1)[:, None]
    logs = np.log((sums + SMOOTHING * totals / totals.sum()) / totals)
    return np.where(np.abs(logs[1] - logs[0]) >= LEAST_RATIO, logs[1] - logs[0], 0.0)


def fit_weights(
    lists: list[np.ndarray], toxic: np.ndarray, scale: np.ndarray, importance: np.ndarray
) -> tuple[np.ndarray, float]:
    """Weights (scaled by ``scale``) and intercept of the penalised logistic regression."""
    flat = np.concatenate(lists) if lists else np.zeros(0, np.int32)
    sizes = np.array([len(x) for x in lists], np.int64)
    owner, values = np.repeat(np.arange(len(sizes)), sizes), scale[flat]
    # Accelerated descent; steps follow a bound of the curvature.
    per_row = np.bincount(owner, values**2, minlength=len(sizes))
    w, b = np.zeros(len(scale)), float(np.log((importance @ toxic + 0.5) / (importance @ (1 - toxic) + 0.5)))
    look, look_b, momentum = w, b, 1.0
    step = 1.0 / (0.25 * (importance @ (per_row + 1)) / 20 + PENALTY)
    last = np.inf
    for _ in range(STEPS):
        margin = np.bincount(owner, values * look[flat], minlength=len(sizes)) + look_b
        error = importance * (1 / (1 + np.exp(-margin)) - toxic)
        loss = importance @ np.logaddexp(0, np.where(toxic == 1, -margin, margin)) + PENALTY / 2 * look @ look
        if loss > last * 1.000001:
            step, momentum, look, look_b = step / 2, 1.0, w, b
        last = loss
        gradient = np.bincount(flat, values * error[owner], minlength=len(scale)) + PENALTY * look
        new, new_b = look - step * gradient, look_b - step * error.sum()
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        look, look_b = new + (momentum - 1) / after * (new - w), new_b + (momentum - 1) / after * (new_b - b)
        w, b, momentum = new, new_b, after
    return w * scale, b


def train(learnable: DataFrame, rows: DataFrame) -> tuple[Vocabulary, np.ndarray, float] | None:
    """Features, a weight for each, and the intercept.

    ``learnable`` has ``doc_id``, ``text``, ``toxic``; ``rows``, of which it is a part, the first two.
    """
    spark = rows.sparkSession
    sizes = {r["toxic"]: r["n"] for r in learnable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    rates = [min(1.0, FIT_ROWS / sizes[k]) if sizes.get(k) else 1.0 for k in (0, 1)]
    place = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1 << 30)) / (1 << 30)
    fit = place < F.when(F.col("toxic") == 1, rates[1]).otherwise(rates[0])
    # About 2 * FIT_ROWS ids at most: broadcast, so the sample's texts are read without a shuffle.
    chosen = written(learnable.where(fit).select("doc_id", "toxic").distinct(), "toxicity-ids")
    sample = written(
        rows.join(F.broadcast(chosen), "doc_id").select(F.col("toxic").cast("int").alias("toxic"), "text"), "toxicity-sample"
    )
    vocabulary = find_vocabulary(sample)
    shared = spark.sparkContext.broadcast(vocabulary)
    counted = written(count_features(learnable.select("text", F.col("toxic").cast("int").alias("toxic")), shared), "toxicity")
    scale = ratios(counted, len(vocabulary))

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            which, at = known(batch.column("text").to_pylist(), shared.value)
            some = scale[at] != 0
            lists = np.split(at[some].astype("<i4"), np.searchsorted(which[some], np.arange(1, batch.num_rows)))
            yield pa.record_batch([batch.column("toxic"), pa.array([x.tobytes() for x in lists])], names=["toxic", "data"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, labels = [], []
        for batch in batches:
            lists += [np.frombuffer(x, "<i4") for x in batch.column("data").to_pylist()]
            labels += batch.column("toxic").to_pylist()
        toxic = np.array(labels, np.float64)
        # A class of which fewer rows were taken counts as many times more.
        importance = np.where(toxic == 1, 1 / rates[1], 1 / rates[0])
        w, b = fit_weights(lists, toxic, scale, importance * len(toxic) / max(importance.sum(), 1))
        yield pa.record_batch([pa.array([w.astype("<f8").tobytes()]), pa.array([b])], names=["weights", "intercept"])

    listed = sample.mapInArrow(scaled, "toxic int, data binary").repartition(1)
    found = listed.mapInArrow(learn, "weights binary, intercept double").first()
    weights = np.frombuffer(found["weights"], "<f8")
    used = np.flatnonzero(weights)
    return Vocabulary(vocabulary.keys[used]), weights[used], found["intercept"]


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    learn_from,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
) -> DataFrame:
    """Per row of ``docs``: doc_id, ``held_out``, ``score`` (0 to 1) and ``predicted``.

    ``learn_from`` is a condition on the id. A row is learnable if it holds and ``labels`` has a label for
    the id; of several labels the largest counts. A missing text is empty; an empty text, or one without
    letters, has the score of the intercept alone. With nothing to learn from, all scores are 0.
    """
    rows = docs.select(F.col(id_column).alias(id_column), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    labelled = labels.where(F.col(label_column).isNotNull()).groupBy(F.col(id_column).alias("labelled")).agg(
        F.max(F.col(label_column).cast("int")).alias("toxic")
    )
    # Labels grow with the corpus, so the plan is the same at every size: a merge, never a broadcast.
    learnable = rows.where(learn_from).join(labelled.hint("merge"), F.col(id_column) == F.col("labelled"))
    model = train(learnable.select(F.col(id_column).alias("doc_id"), "text", "toxic"), rows.select(F.col(id_column).alias("doc_id"), "text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sums = np.zeros(batch.num_rows)
            if shared.value is not None:
                vocabulary, weights, intercept = shared.value
                margin = margins(batch.column("text").to_pylist(), vocabulary, weights) + intercept
                sums = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(sums), pa.array((sums >= TOXIC_FROM).astype("i4"))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    held = ~F.coalesce(learn_from, F.lit(False))
    return rows.select(F.col(id_column).cast("long").alias("doc_id"), held.alias("held_out"), "text").mapInArrow(
        score, "doc_id long, held_out boolean, score double, predicted int"
    )
