"""Toxicity of held-out texts, and odd ones."""

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tests.llm.helpers import frame, odd_documents
from tidewatch.llm.queries import QUERIES
from tidewatch.llm.toxicity import (
    LEAST_RATIO,
    ORDERS,
    SMOOTHING,
    TOXIC_FROM,
    Vocabulary,
    count_features,
    features,
    find_vocabulary,
    margins,
    ratios,
    score_toxicity,
)


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = pd.read_parquet(f"{sf_dir}/labels.parquet")
    got = QUERIES["op6_toxicity"](spark, sf_dir).toPandas()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= TOXIC_FROM)).all()
    assert got.held_out.tolist() == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]
    held = got[got.held_out].merge(labels, on="doc_id")
    toxic, clean = held[held.toxic == 1], held[held.toxic == 0]
    above = (toxic.score.to_numpy()[:, None] > clean.score.to_numpy()).mean()
    assert above > 0.85 and clean.predicted.mean() < 0.02  # 30 toxic rows to learn from


def test_a_planted_word_is_learnt(spark):
    rows = [(i, f"some words about the weather number{i} " + ("zzyzx blah" if i % 4 == 0 else "nothing else")) for i in range(400)]
    docs = frame(spark, rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic")).where("doc_id < 300")
    got = score_toxicity(docs, labels, F.col("doc_id") % 3 != 1).toPandas()
    assert (got.predicted == (got.doc_id % 4 == 0)).all()


def test_odd_rows(spark):
    docs = odd_documents(spark)
    labels = frame(spark, [(5, 1), (5, 0), (6, 0), (4, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    got = score_toxicity(docs, labels, F.lit(True)).toPandas()
    assert len(got) == docs.count() and got.score.notna().all()
    assert score_toxicity(docs.limit(0), labels, F.lit(True)).count() == 0
    assert set(score_toxicity(docs, labels.limit(0), F.lit(True)).toPandas().score) == {0.0}


def test_features_are_the_same_in_any_company():
    texts = ["", "a longer text of several words", "x", "y" * 250_000, "a longer text again"]
    together = features(texts)
    vocabulary = Vocabulary(np.unique(np.concatenate(together[:4]))[::2])
    weights = np.random.default_rng(1).normal(size=len(vocabulary))
    for t, own, margin in zip(texts, together, margins(texts, vocabulary, weights), strict=True):
        assert own.tolist() == features([t])[0].tolist() == sorted(set(own.tolist()))
        at = vocabulary.find(own)
        assert np.isclose(margin, weights[at[at >= 0]].sum())


def test_every_key_is_found_beyond_a_million():
    """More keys than the 2^19 buckets there once were: none shares an entry."""
    keys = np.unique(np.random.default_rng(2).integers(0, 1 << 62, 1_200_000))
    vocabulary = Vocabulary(keys[::2])
    found = vocabulary.find(keys)
    assert (found[::2] == np.arange(len(vocabulary))).all() and (found[1::2] == -1).all()
    assert Vocabulary(keys[:0]).find(keys[:3]).tolist() == [-1, -1, -1]


def grams(text):
    """The n-grams of a text as strings, one by one, edges before the text included."""
    folded = re.sub(" +", " ", "".join(c.lower() if c.isalpha() else " " for c in text))
    edged = "\0" * (max(ORDERS) - 1) + f" {folded.lstrip(' ')} "
    return {edged[i - n : i] for n in ORDERS for i in range(max(ORDERS), len(edged) + 1)}


def test_ratios_equal_brute_force(spark):
    texts = [(f"rotten fish {i % 7}" if i % 3 == 0 else f"fresh Fish, number {i % 5}", int(i % 3 == 0)) for i in range(60)]
    own = [grams(t) for t, _ in texts]
    names = sorted(set().union(*own))
    counts = {g: [sum(g in o and y == label for o, (_, y) in zip(own, texts, strict=True)) for label in (0, 1)] for g in names}
    totals = [sum(c[label] for c in counts.values()) for label in (0, 1)]
    shares = [[(c[k] + SMOOTHING * totals[k] / sum(totals)) / totals[k] for k in (0, 1)] for c in counts.values()]
    expected = [r if abs(r) >= LEAST_RATIO else 0.0 for r in (np.log(s[1] / s[0]) for s in shares)]
    rows = frame(spark, texts, "text string, toxic int").repartition(4)
    vocabulary = find_vocabulary(rows)
    got = ratios(count_features(rows, spark.sparkContext.broadcast(vocabulary)), len(vocabulary))
    assert len(vocabulary) == len(names)
    assert np.allclose(np.sort(got), np.sort(expected), atol=1e-12)
