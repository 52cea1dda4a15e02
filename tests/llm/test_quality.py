"""Perplexities against a plain modified Kneser-Ney model."""

import math
from collections import Counter, defaultdict
from functools import lru_cache

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import frame, odd_documents
from tidewatch.llm import quality
from tidewatch.llm.quality import ORDER, calibrates, classify
from tidewatch.llm.queries import QUERIES


class Plain:
    def __init__(self, texts):
        grams = Counter(g for t in texts for g in self.grams(t))
        self.counts = {ORDER: grams}
        for k in range(ORDER - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.sums, self.cuts = {}, {}
        for k, counts in self.counts.items():
            n = [max(1, sum(c == j for c in counts.values())) for j in range(1, 5)]
            y = n[0] / (n[0] + 2 * n[1])
            self.cuts[k] = [min(max(j - (j + 1) * y * n[j] / n[j - 1], 0.05), j - 0.05) for j in (1, 2, 3)]
            self.sums[k] = defaultdict(lambda: [0, 0.0])
            for g, c in counts.items():
                self.sums[k][g[:-1]][0] += c
                self.sums[k][g[:-1]][1] += self.cuts[k][min(c, 3) - 1]

    @staticmethod
    def grams(text):
        padded = "\0" * (ORDER - 1) + text
        return [padded[i : i + ORDER] for i in range(len(text))]

    def p(self, g):
        if not g:
            return 1 / (len(self.counts[1]) + 1)
        below, k = self.p(g[1:]), len(g)
        if g[:-1] not in self.sums[k]:
            return below
        total, cut = self.sums[k][g[:-1]]
        c = self.counts[k][g]
        return (c - self.cuts[k][min(c, 3) - 1] if c else 0) / total + cut / total * below

    def perplexity(self, text):
        return math.exp(-sum(math.log(self.p(g)) for g in self.grams(text)) / len(text)) if text else None


@pytest.mark.parametrize("common", [1 << 18, 300, 0])
def test_perplexity(spark, monkeypatch, common):
    monkeypatch.setattr(quality, "COMMON_GRAMS", common)
    docs = pd.read_parquet("/root/testdata/sf0.001/documents.parquet").sort_values("doc_id").head(24)
    docs = [(int(i), t[:1500], "en") for i, t in zip(docs.doc_id, docs.text, strict=True)] + [(1000, "ab", None), (1000, "ab", None), (1001, "", "en")]
    rows = frame(spark, docs, "doc_id long, text string, lang string")
    labels = frame(spark, [(i, int(i % 2 == 0)) for i, _, _ in docs], "doc_id long, quality int")
    apart = {r.doc_id for r in rows.where(calibrates(F.col("doc_id"))).collect()}
    model = Plain([t for i, t, _ in docs if i % 2 == 0 and i not in apart])
    got = classify(rows, labels).collect()
    assert len(got) == len(docs)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r.perplexity)
    for i, text, _ in docs:
        assert by[i][0] == pytest.approx(model.perplexity(text), rel=1e-4) if text else by[i][0] is None


def quantile(values, share):
    return sorted(values)[max(0, math.ceil(share * len(values)) - 1)]


def test_verdicts_on_whole_texts(spark, monkeypatch):
    """Limits and verdicts of every document of the smallest tables against a plain count over the same model."""
    monkeypatch.setattr(quality, "COMMON_GRAMS", 5_000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    got = {r.doc_id: r for r in classify(docs, labels).collect()}
    apart = {r.doc_id for r in docs.where(calibrates(F.col("doc_id"))).collect()}
    labelled = defaultdict(set)
    for r in labels.where("quality IS NOT NULL").collect():
        labelled[r.doc_id].add(r.quality)
    good = {i for i, seen in labelled.items() if seen == {1}}
    rows = [(r.doc_id, r.text or "", r.lang) for r in docs.collect()]
    model = Plain([t for i, t, _ in rows if i in good and i not in apart])
    model.p = lru_cache(maxsize=None)(model.p)
    plain = {i: (model.perplexity(t), len(t), lang) for i, t, lang in rows}
    seen = [v for i, v in plain.items() if i in good & apart and v[0]]
    langs = {v[2] for v in seen}

    def judged(perplexity, size, lang):
        median = quantile([p for p, _, other in seen if other == lang or lang not in langs], 0.5)
        return math.exp((size * math.log(perplexity) + quality.PRIOR_CHARACTERS * math.log(median)) / (size + quality.PRIOR_CHARACTERS))

    limits = {lang: quality.MARGIN * quantile([judged(*v) for v in seen if v[2] == lang], quality.QUANTILE) for lang in langs}
    general = quality.MARGIN * quantile([judged(*v) for v in seen], quality.QUANTILE)
    assert len(got) == len(rows) and seen and not all(r.kept for r in got.values())
    for i, (perplexity, size, lang) in plain.items():
        limit = limits.get(lang, general)
        assert got[i].limit == pytest.approx(limit, rel=1e-5)
        assert got[i].kept == (perplexity is None or judged(perplexity, size, lang) <= limit)


def test_query_keeps_clean_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = pd.read_parquet(f"{sf_dir}/labels.parquet")
    got = QUERIES["op3_quality"](spark, sf_dir).toPandas().merge(labels, on="doc_id", how="left")
    assert got[got.quality.isna()].kept.mean() > 0.8  # one in seven is junk
    assert got[got.quality == 1].kept.mean() > 0.99
    assert got[got.quality == 0].kept.mean() < 0.1


def test_odd_rows(spark):
    docs = odd_documents(spark)
    labels = frame(spark, [(5, 1), (6, 1), (6, 0), (7, None), (None, 1)], "doc_id long, quality int")
    got = classify(docs, labels).toPandas()
    assert len(got) == docs.count() and got[got.doc_id.isin([1, 2])].kept.all()
    assert classify(docs.limit(0), labels).count() == 0
    assert classify(docs, labels.limit(0)).toPandas().kept.all()
