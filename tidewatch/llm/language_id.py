"""Language of a text by character models, one per language.

Each model is an interpolated Kneser-Ney model of orders 1 to ``ORDER`` over lower-cased letters and
single spaces. Its counts are of the learnable rows but for a fold of them, which sets how far a score
is to be trusted and which texts are rejected; n-grams are kept by a hash of ``BITS`` bits, so entries follow the
n-grams found (of letters, hence some ten thousand for an alphabet, however much is read). All models together are
sorted arrays of hashes with a column per language. A text's language is that of the lowest cross-entropy
per character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import slices, written
from tidewatch.llm.grams import hashes, letters, segments, spread_bits

ORDER = 4
BITS = 62
FOLD = 10  # one learnable row in so many is left out of the counts,
FOLD_FROM = 100  # of the languages with so many of them
NO_LANGUAGE = "und"
# Powers of the evidence tried; the one that fits the learnable rows best makes the score.
SHARPNESS = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0)
# A text is rejected when its cross-entropy is above this quantile of its language's own texts.
REJECT_ABOVE = 0.999
# So that no character is impossible where no gram is seen just once.
LEAST_DISCOUNT = 0.01
_MERGE_AT = 1_000_000


def _keys(flat: np.ndarray, at: np.ndarray, order: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Hashed grams of orders 1..order at the scored positions, and their contexts of orders 0..order-1."""
    h = hashes(flat, order)
    grams = [spread_bits(h[k][at], BITS) for k in range(1, order + 1)]
    contexts = [spread_bits(h[k][at - 1], BITS) if k else np.zeros(len(at), np.int64) for k in range(order)]
    return grams, contexts


def count_grams(rows: DataFrame) -> DataFrame:
    """Counts of the highest order by language, with the keys of all lower grams and contexts."""
    names = [f"g{k}" for k in range(1, ORDER + 1)] + [f"c{k}" for k in range(1, ORDER)]

    def merge(parts: list[pd.DataFrame]) -> pd.DataFrame:
        both = pd.concat(parts)
        sums = both.groupby(["lang", f"g{ORDER}"], sort=False)["n"].sum().reset_index()
        return both.drop_duplicates(["lang", f"g{ORDER}"]).drop(columns="n").merge(sums, on=["lang", f"g{ORDER}"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in slices(batches):
            langs = batch.column("lang").to_pylist()
            texts = [letters(t) for t in batch.column("text").to_pylist()]
            for lang in dict.fromkeys(langs):
                for flat, at, _ in segments([t for t, l in zip(texts, langs, strict=True) if l == lang], ORDER):
                    grams, contexts = _keys(flat, at, ORDER)
                    top, first, n = np.unique(grams[-1], return_index=True, return_counts=True)
                    columns = {f"g{k + 1}": g[first] for k, g in enumerate(grams)}
                    columns |= {f"c{k}": c[first] for k, c in enumerate(contexts) if k}
                    parts.append(pd.DataFrame({"lang": lang, **columns, "n": n}))
                    size += len(top)
            if size > _MERGE_AT:
                parts = [merge(parts)]
                size = min(len(parts[0]), _MERGE_AT // 2)
        if parts:
            done = merge(parts)
            for at in range(0, len(done), 100_000):
                part = done.iloc[at : at + 100_000]
                yield pa.record_batch(
                    [pa.array(part["lang"], pa.string()), *(pa.array(part[c], pa.int64()) for c in names), pa.array(part["n"], pa.int64())],
                    names=["lang", *names, "n"],
                )

    counted = rows.mapInArrow(count, "lang string, " + ", ".join(f"{c} long" for c in names) + ", n long")
    # One gram of the highest order may come with other keys where hashes meet; any of them will do.
    return counted.groupBy("lang", f"g{ORDER}").agg(*[F.min(c).alias(c) for c in names if c != f"g{ORDER}"], F.sum("n").alias("n"))


def _model(frame: pd.DataFrame) -> pd.DataFrame:
    """One language's model from its different n-grams: an entry per order, as packed arrays."""
    out, level = [], frame
    for k in range(ORDER, 0, -1):
        counts = level["n"].to_numpy(np.float64)
        ones, twos = (counts == 1).sum(), (counts == 2).sum()
        discount = max(ones / max(ones + 2 * twos, 1), LEAST_DISCOUNT)
        context = level[f"c{k - 1}"].to_numpy() if k > 1 else np.zeros(len(level), np.int64)
        totals = level["n"].groupby(context).agg(["sum", "count"]).sort_index()
        grams = level[f"g{k}"].to_numpy()
        order = np.argsort(grams)
        out.append(
            (
                level["lang"].iloc[0],
                k,
                grams[order].astype("<i8").tobytes(),
                np.maximum(counts - discount, 0)[order].astype("<f4").tobytes(),
                totals.index.to_numpy().astype("<i8").tobytes(),
                totals["sum"].to_numpy().astype("<f4").tobytes(),
                (discount * totals["count"] / totals["sum"]).to_numpy().astype("<f4").tobytes(),
            )
        )
        if k > 1:  # below the highest order, a gram counts by the different characters before it
            lower = [f"g{j}" for j in range(1, k)] + [f"c{j}" for j in range(1, k - 1)]
            sizes = level.groupby(f"g{k - 1}")["n"].size()
            level = level.drop_duplicates(f"g{k - 1}")[["lang", *lower]]
            level = level.assign(n=level[f"g{k - 1}"].map(sizes).to_numpy())
    return pd.DataFrame(out, columns=["lang", "k", "grams", "kept", "contexts", "totals", "weights"])


class Models:
    """All languages' models: per order, sorted hashes and a column of values per language."""

    def __init__(self, parts: pd.DataFrame):
        self.langs = sorted(set(parts["lang"]))
        self.orders = {}
        vocabulary = 1
        for k in range(1, ORDER + 1):
            rows = parts[parts["k"] == k]
            grams, kept = self._columns(rows, "grams", ["kept"])
            contexts, totals, weights = self._columns(rows, "contexts", ["totals", "weights"])
            if k == 1:
                vocabulary = len(grams) + 1
            self.orders[k] = (grams, kept, contexts, totals, weights)
        self.base = np.float32(1 / vocabulary)

    def _columns(self, rows: pd.DataFrame, key: str, values: list[str]) -> tuple[np.ndarray, ...]:
        keys = np.unique(np.concatenate([np.frombuffer(b, "<i8") for b in rows[key]]))
        out = [np.zeros((len(keys), len(self.langs)), np.float32) for _ in values]
        if "weights" in values:  # a context never seen leaves all to the lower order
            out[0][:] = np.inf
            out[1][:] = 1
        for row in rows.itertuples():
            at = np.searchsorted(keys, np.frombuffer(getattr(row, key), "<i8"))
            for column, name in zip(out, values, strict=True):
                column[at, self.langs.index(row.lang)] = np.frombuffer(getattr(row, name), "<f4")
        return keys, *out

    def log_probabilities(self, grams: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
        p = np.full((len(grams[0]), len(self.langs)), self.base, np.float32)
        for k, (keys, kept, above, totals, weights) in self.orders.items():
            at = np.minimum(np.searchsorted(keys, grams[k - 1]), len(keys) - 1)
            seen = np.where((keys[at] == grams[k - 1])[:, None], kept[at], np.float32(0))
            at = np.minimum(np.searchsorted(above, contexts[k - 1]), len(above) - 1)
            known = (above[at] == contexts[k - 1])[:, None]
            p = seen / np.where(known, totals[at], np.float32(np.inf)) + np.where(known, weights[at], np.float32(1)) * p
        return np.log(p)

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character for each text and language, and the characters of each text."""
        sums, sizes = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        for flat, at, which in segments([letters(t) for t in texts], ORDER):
            top = hashes(flat, ORDER)[ORDER][at]
            _, first, inverse = np.unique(top, return_index=True, return_inverse=True)
            grams, contexts = _keys(flat, at[first], ORDER)
            values = self.log_probabilities(grams, contexts)[inverse]
            starts = np.flatnonzero(np.diff(which, prepend=-1))
            sums[which[starts]] += np.add.reduceat(values, starts, axis=0)
            sizes += np.bincount(which, minlength=len(texts))
        return -sums / np.maximum(sizes, 1)[:, None], sizes


def train(rows: DataFrame) -> Models | None:
    """Models from the columns ``lang`` and ``text``; None if there is nothing to learn from."""
    parts = count_grams(rows).groupBy("lang").applyInPandas(
        _model, "lang string, k int, grams binary, kept binary, contexts binary, totals binary, weights binary"
    )
    frame = parts.toPandas()
    return Models(frame) if len(frame) else None


def identify(
    docs: DataFrame,
    learn_from,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    reject_above: float = REJECT_ABOVE,
) -> DataFrame:
    """Per row: doc_id, ``held_out``, ``lang_pred``, ``score``, ``cross_entropy`` and ``rejected``.

    ``learn_from`` is a condition on ``docs``: the models learn from those of its rows that have a
    language. A text that is missing or has no letter is ``und`` with score 0 (so is every text if there
    is nothing to learn from). The score is the share of the best language when each has the weight
    exp(-sharpness * cross-entropy), with the sharpness that makes the learnable rows left out of the counts
    likeliest. A row is ``rejected`` if its cross-entropy is above a high quantile of those of these rows
    that were rightly given the same language; a language with too few of them for that
    quantile (a thousand for 0.999) rejects nothing. Equal cross-entropies go to the first name in order.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_column), F.lit("")).alias("text"),
        F.when(learn_from, F.col(lang_column)).alias("lang"),
        F.coalesce(learn_from, F.lit(False)).alias("learn"),
    )
    taught = rows.where(F.col("lang").isNotNull())
    large = [r["lang"] for r in taught.groupBy("lang").count().where(F.col("count") >= FOLD_FROM).collect()]  # names only
    left_out = F.coalesce(F.col("lang").isin(large), F.lit(False)) & (F.pmod(F.xxhash64("doc_id", "text"), F.lit(FOLD)) == 0)
    models = train(taught.where(~left_out).select("lang", "text"))
    if models is None:
        none = rows.select(
            "doc_id", (~F.col("learn")).alias("held_out"), F.lit(NO_LANGUAGE).alias("lang_pred"), F.lit(0.0).alias("score")
        )
        return none.withColumns({"cross_entropy": F.lit(0.0), "rejected": F.lit(True)})
    shared = spark.sparkContext.broadcast(models)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            entropy, sizes = shared.value.cross_entropies(batch.column("text").to_pylist())
            ends = np.arange(0, entropy.size + 1, entropy.shape[1], dtype="<i4")
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(entropy.ravel()))
            yield pa.record_batch(
                [*(batch.column(c) for c in ("doc_id", "lang", "learn", "left_out")), lists, pa.array(sizes)],
                names=["doc_id", "lang", "learn", "left_out", "entropy", "size"],
            )

    scored = written(
        rows.withColumn("left_out", left_out).mapInArrow(
            score, "doc_id long, lang string, learn boolean, left_out boolean, entropy array<double>, size long"
        ),
        "languages",
    )
    least = F.array_min("entropy")
    names = F.array(*[F.lit(x) for x in models.langs])
    best = F.get(names, (F.array_position("entropy", least) - 1).cast("int"))

    def share(entropy, sharpness: float):
        weights = F.transform("entropy", lambda e: F.exp(F.lit(-sharpness) * (e - F.array_min("entropy"))))
        own = F.exp(F.lit(-sharpness) * (entropy - F.array_min("entropy")))
        return own / F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)

    known = scored.where(F.col("left_out") & F.col("lang").isNotNull() & (F.col("size") > 0))
    true = F.get("entropy", (F.array_position(names, F.col("lang")) - 1).cast("int"))
    fits = known.agg(*[F.avg(F.log(F.greatest(share(true, s), F.lit(1e-12)))).alias(f"s{i}") for i, s in enumerate(SHARPNESS)]).first()
    sharpness = SHARPNESS[int(np.argmax([-np.inf if v is None else v for v in fits]))]
    limits = known.where(best == F.col("lang")).groupBy(F.col("lang").alias("lang_pred")).agg(
        F.percentile_approx(least, reject_above, 10_000).alias("limit"), F.count("*").alias("n")
    )
    limits = limits.where(F.col("n") * (1 - reject_above) >= 1 - 1e-9).drop("n")
    found = F.col("size") > 0
    return (
        scored.select(
            "doc_id",
            (~F.col("learn")).alias("held_out"),
            F.when(found, best).otherwise(NO_LANGUAGE).alias("lang_pred"),
            F.when(found, share(least, sharpness)).otherwise(0.0).alias("score"),
            F.when(found, least).otherwise(0.0).alias("cross_entropy"),
        )
        .join(F.broadcast(limits), "lang_pred", "left")
        .select(
            "doc_id", "held_out", "lang_pred", "score", "cross_entropy",
            ((F.col("lang_pred") == NO_LANGUAGE) | F.coalesce(F.col("cross_entropy") > F.col("limit"), F.lit(False))).alias("rejected"),
        )
    )
