"""Document quality by the perplexity of a character n-gram model of trusted text.

The model is an interpolated modified Kneser-Ney model. Its counts, continuation counts and context
sums are tables keyed by the n-gram, as large as the text makes them, and the probabilities of all
n-grams that occur in any document come from joins of these tables, one order after the other. One
scan of the texts then gives each document its sums: the most frequent n-grams, at most
``COMMON_GRAMS``, are looked up in a broadcast table; of all others the scan leaves (document, n-gram,
count), which meet their log-probabilities in a join on the n-gram. None of those is a hot key, as
each is rarer than every frequent one.

A document is rejected when its perplexity, drawn towards the median as far as it is short, is above the limit of its language: a high quantile of the
trusted documents of that language that the model has not read, with a margin.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import slices, written
from tidewatch.llm.grams import hashes, points, segments

ORDER = 5
COMMON_GRAMS = 1 << 18  # 12 bytes each in a broadcast; more change what is shuffled, not the result
SCALE = 1 << 24  # log-probabilities are added up as whole numbers of this part, so their order doesn't count
QUANTILE = 0.995
MARGIN = 1.15  # the limit is that quantile times this
# A text is judged as if so many more characters had its language's median perplexity: a few say little.
PRIOR_CHARACTERS = 50
# One trusted document in so many is left out of the model: the limits come from these, as a model
# finds the text it has read itself easier than any other.
FOLDS = 5
_FLUSH_AT = 400_000


def count_grams(docs: DataFrame) -> DataFrame:
    """(gram, n) of every n-gram of the column ``text``; a text begins with edges."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, spelt, counts = np.zeros(0, np.uint64), np.zeros(0, f"V{4 * ORDER}"), np.zeros(0, np.int64)
        for batch in slices(batches):
            for flat, at, _ in segments([points(t) for t in batch.column("text").to_pylist()], ORDER):
                h, first, n = np.unique(hashes(flat, ORDER)[ORDER][at], return_index=True, return_counts=True)
                own = flat[at[first][:, None] + np.arange(1 - ORDER, 1)]
                own = np.ascontiguousarray(own).view(f"V{4 * ORDER}").ravel()
                both = np.concatenate([keys, h])
                keys, first, inverse = np.unique(both, return_index=True, return_inverse=True)
                spelt = np.concatenate([spelt, own])[first]
                counts = np.bincount(inverse, np.concatenate([counts, n]), minlength=len(keys)).astype(np.int64)
            if len(keys) > _FLUSH_AT:
                yield from rows(spelt, counts)
                keys, spelt, counts = keys[:0], spelt[:0], counts[:0]
        yield from rows(spelt, counts)

    def rows(spelt: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(spelt), 50_000):
            text = spelt[at : at + 50_000].tobytes().decode("utf-32-le", "replace")
            grams = [text[i : i + ORDER] for i in range(0, len(text), ORDER)]
            yield pa.record_batch([pa.array(grams), pa.array(counts[at : at + 50_000])], names=["gram", "n"])

    return docs.select("text").mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> list[float]:
    """The discounts of n-grams seen once, twice and more often, by how many there are of each kind."""
    seen = counts.agg(*[F.count(F.when(F.col("n") == k, 1)).alias(f"n{k}") for k in range(1, 5)]).first()
    n = [max(1, v) for v in seen]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3)]


def _cut(discounts: list[float]) -> Column:
    return F.when(F.col("n") == 1, discounts[0]).when(F.col("n") == 2, discounts[1]).otherwise(discounts[2])


def probabilities(trusted: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, n, log_p) of each of the ``wanted`` n-grams, (gram, n), under the model of the ``trusted`` counts."""
    counts = {ORDER: trusted}
    asked = {ORDER: wanted.select("gram", F.col("n").alias("times"))}
    for k in range(ORDER - 1, 0, -1):
        lower = F.substring("gram", 2, k).alias("gram")
        # Each order's tables are stored, so no plan spans more than one order.
        counts[k] = written(counts[k + 1].select(lower).groupBy("gram").agg(F.count("*").alias("n")), "lower-counts")
        asked[k] = written(asked[k + 1].select(lower).distinct(), "lower-asked")
    letters = counts[1].count()
    found = None
    for k in range(1, ORDER + 1):
        cut = _cut(_discounts(counts[k]))
        context = F.substring("gram", 1, k - 1).alias("context")
        sums = counts[k].select(context, "n", cut.alias("cut")).groupBy("context").agg(
            F.sum("n").alias("total"), (F.sum("cut") / F.sum("n")).alias("left")
        )
        own = counts[k].select("gram", (F.col("n") - cut).alias("kept"))
        rows = asked[k].select("*", context, F.substring("gram", 2, k - 1).alias("lower"))
        if found is None:
            rows = rows.withColumn("below", F.lit(1.0 / (letters + 1)))
        else:
            rows = rows.join(found.select(F.col("gram").alias("lower"), F.col("p").alias("below")), "lower")
        p = F.coalesce(F.col("kept") / F.col("total"), F.lit(0.0)) + F.coalesce("left", F.lit(1.0)) * F.col("below")
        found = written(rows.join(sums, "context", "left").join(own, "gram", "left").select(*asked[k].columns, p.alias("p")), "probabilities")
    return found.select("gram", F.col("times").alias("n"), F.log("p").alias("log_p"))


def hashed(table: DataFrame) -> DataFrame:
    """(key, n, weight): the n-grams by the hash that a scan of a text gives them; weight is log_p in parts of SCALE."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 50_000):
            flat = points("".join(batch.column("gram").to_pylist()))
            keys = hashes(flat, ORDER)[ORDER][ORDER - 1 :: ORDER]
            yield pa.record_batch([pa.array(keys.view(np.int64)), batch.column("n"), batch.column("weight")], names=["key", "n", "weight"])

    weight = F.round(F.col("log_p") * SCALE).cast("long")
    return table.select("gram", "n", weight.alias("weight")).mapInArrow(key, "key long, n long, weight long")


def _least_common(table: DataFrame) -> float:
    """The n-grams in classes by the logarithm of their count: the least class of which, with all above, few enough are."""
    classes = table.groupBy(_class().alias("c")).agg(F.count("*").alias("n")).collect()
    least, held = float("inf"), 0
    for c, n in sorted(map(tuple, classes), reverse=True):
        held += n
        if held > COMMON_GRAMS:
            break
        least = c
    return least


def _class() -> Column:
    return F.floor(F.log2("n") * 8).cast("double")


def _scan(rows: DataFrame, common: DataFrame) -> DataFrame:
    """Each row's characters, its sum over the common n-grams, and its other n-grams with their counts."""
    held = common.toArrow()
    keys, values = (held.column(c).to_numpy() for c in ("key", "weight"))
    order = np.argsort(keys)
    # One more weight, as the place of a key beyond all others is the table's length.
    table = rows.sparkSession.sparkContext.broadcast((keys[order], np.append(values[order], 0)))
    del held, keys, values, order

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, weights = table.value
        for batch in slices(batches):
            texts = [points(t) for t in batch.column("text").to_pylist()]
            total, size = np.zeros(len(texts), np.int64), np.array([len(t) for t in texts], np.int64)
            where, grams = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for flat, at, which in segments(texts, ORDER):
                h, inverse = np.unique(hashes(flat, ORDER)[ORDER][at].view(np.int64), return_inverse=True)
                place = np.searchsorted(keys, h)
                known = keys[np.minimum(place, len(keys) - 1)] == h if len(keys) else np.zeros(len(h), bool)
                # Whole numbers below 2^53: a piece has at most SEGMENT characters.
                piece = np.bincount(which, np.where(known, weights[place], 0)[inverse], minlength=len(texts))
                total += piece.astype(np.int64)
                rest = ~known[inverse]
                where.append(which[rest])
                grams.append(h[inverse[rest]])
            where, grams = np.concatenate(where), np.concatenate(grams)
            order = np.lexsort((grams, where))
            where, grams = where[order], grams[order]
            first = np.flatnonzero(np.r_[True, (where[1:] != where[:-1]) | (grams[1:] != grams[:-1])][: len(where)])
            times = np.diff(np.append(first, len(where)))
            ends = pa.array(np.searchsorted(where[first], np.arange(len(texts) + 1)).astype(np.int32))
            yield pa.record_batch(
                [
                    *(batch.column(c) for c in ("row", "doc_id", "lang")),
                    *(pa.array(total), pa.array(size)),
                    pa.ListArray.from_arrays(ends, pa.array(grams[first])),
                    pa.ListArray.from_arrays(ends, pa.array(times)),
                ],
                names=["row", "doc_id", "lang", "total", "size", "key", "times"],
            )

    sums = rows.mapInArrow(score, "row long, doc_id long, lang string, total long, size long, key array<long>, times array<long>")
    # The numbers are written with the rows, so they stay what they are.
    sums = written(sums.withColumn("place", F.monotonically_increasing_id()), "sums")
    table.destroy()
    return sums


def perplexities(
    docs: DataFrame, trusted: DataFrame, id_column: str, text_column: str, lang_column: str
) -> DataFrame:
    """Per row: row (xxhash64 of the text), doc_id, lang and perplexity (null for an empty text), size.

    ``trusted`` has a column ``text``. Without any trusted text all characters are alike.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(
        F.xxhash64(text).alias("row"), F.col(id_column).cast("long").alias("doc_id"), F.col(lang_column).cast("string").alias("lang"), text.alias("text")
    )
    wanted = written(count_grams(rows), "grams")
    counts = written(count_grams(trusted), "trusted-grams")
    table = written(hashed(probabilities(counts, wanted)), "log-probabilities")
    least = _least_common(table)
    sums = _scan(rows, table.where(_class() >= least).select("key", "weight"))
    others = table.where(_class() < least).groupBy("key").agg(F.min("weight").alias("weight"))
    asked = sums.select("place", F.explode(F.arrays_zip("key", "times")).alias("gram")).select("place", "gram.key", "gram.times")
    lost = F.raise_error(F.lit("the texts changed between counting and scoring")).cast("long")
    part = F.when(F.col("weight").isNull(), lost).otherwise(F.col("weight") * F.col("times"))
    # Both sides grow with the corpus, so the plan is the same at every size: merges, never a broadcast.
    rest = asked.join(others.hint("merge"), "key", "left").groupBy("place").agg(F.sum(part).alias("rest"))
    total = F.col("total") + F.coalesce("rest", F.lit(0))
    perplexity = F.when(F.col("size") > 0, F.exp(-total / F.lit(SCALE) / F.col("size")))
    found = sums.drop("key", "times").join(rest.hint("merge"), "place", "left")
    return found.select("row", "doc_id", "lang", perplexity.alias("perplexity"), "size")


def calibrates(doc_id: Column) -> Column:
    """Whether a trusted document serves the limits, not the model."""
    return F.pmod(F.xxhash64(doc_id, F.lit(3)), F.lit(FOLDS)) == 0


def classify(
    docs: DataFrame,
    labels: DataFrame,
    quantile: float = QUANTILE,
    margin: float = MARGIN,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    label_column: str = "quality",
) -> DataFrame:
    """Per row: row (xxhash64 of the text), doc_id, lang, ``perplexity``, ``judged``, ``limit`` and ``kept``.

    Trusted are the rows whose id has the label 1 and no label 0; a fifth of them by id serves the
    limits, the others the model. ``limit`` is the quantile of the limits' rows of the row's language (a
    missing language is one too), or of all languages where a language has none, times ``margin``. Empty and missing texts have no perplexity and are kept, and
    so is everything if nothing is trusted. Repeated rows are scored alike. Other columns are ignored.
    """
    known = labels.where(F.col(label_column).isNotNull()).groupBy(F.col(id_column).cast("long").alias("_id")).agg(
        F.min(F.col(label_column)).alias("_label")
    )
    good = written(known.where("_label = 1").select("_id"), "trusted-ids")
    trusted = docs.select(F.col(id_column).cast("long").alias("_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    trusted = trusted.where(~calibrates(F.col("_id"))).join(good.hint("merge"), "_id", "left_semi").select("text")
    scored = written(perplexities(docs, trusted, id_column, text_column, lang_column), "perplexities")
    seen = scored.where(F.col("perplexity").isNotNull() & calibrates(F.col("doc_id")))
    seen = seen.join(good, F.col("doc_id") == F.col("_id"), "left_semi")
    medians = seen.groupBy(F.col("lang").alias("_lang")).agg(F.percentile_approx("perplexity", 0.5, 10_000).alias("_median"))
    general = seen.agg(F.percentile_approx("perplexity", 0.5, 10_000).alias("m")).first()["m"]
    same = F.col("lang").eqNullSafe(F.col("_lang"))

    def judged(rows: DataFrame) -> DataFrame:
        median = F.coalesce("_median", F.lit(general).cast("double"), "perplexity")
        drawn = (F.col("size") * F.log("perplexity") + PRIOR_CHARACTERS * F.log(median)) / (F.col("size") + PRIOR_CHARACTERS)
        return rows.join(F.broadcast(medians), same, "left").drop("_lang").withColumn("judged", F.exp(drawn))

    limit = (F.percentile_approx("judged", quantile, 10_000) * margin).alias("limit")
    trusted_rows = judged(seen)
    general_limit = trusted_rows.agg(limit).first()["limit"]
    limits = trusted_rows.groupBy(F.col("lang").alias("_lang")).agg(limit)
    out = judged(scored).join(F.broadcast(limits), same, "left")
    found = F.coalesce("limit", F.lit(general_limit).cast("double"))
    kept = F.coalesce(F.col("judged") <= found, F.lit(True))
    return out.select("row", "doc_id", "lang", "perplexity", "judged", found.alias("limit"), kept.alias("kept"))
