"""Language of held-out texts, and odd ones."""

import math
import zlib
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents, odd_documents
from tidewatch.llm.grams import letters, segments
from tidewatch.llm.language_id import ORDER, Models, _keys, _model, identify
from tidewatch.llm.queries import QUERIES


def test_query(spark, sf_dir):
    docs = documents(sf_dir)
    got = QUERIES["op4_language_id"](spark, sf_dir).toPandas().merge(docs[["doc_id", "lang"]], on="doc_id")
    assert len(got) == len(docs) and got.score.between(0, 1).all()
    assert got.held_out.tolist() == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() >= 0.97


def brute_models(rows):
    """Interpolated Kneser-Ney by dictionaries of strings: (text, lang) rows to a function of text and language."""
    counts = {}
    for text, lang in rows:
        p = "\0" * (ORDER - 1) + "".join(map(chr, letters(text)))
        for i in range(ORDER - 1, len(p)):
            gram = p[i - ORDER + 1 : i + 1]
            counts.setdefault(lang, Counter())[gram] += 1
    levels = {}
    for lang, top in counts.items():
        levels[lang] = {ORDER: top}
        for k in range(ORDER - 1, 0, -1):
            levels[lang][k] = Counter(g[1:] for g in levels[lang][k + 1])
    vocabulary = len({g for own in levels.values() for g in own[1]}) + 1

    def entropy(text, lang):
        p = "\0" * (ORDER - 1) + "".join(map(chr, letters(text)))
        total = 0.0
        for i in range(ORDER - 1, len(p)):
            chance = 1 / vocabulary
            for k in range(1, ORDER + 1):
                own, gram = levels[lang][k], p[i - k + 1 : i + 1]
                ones, twos = (sum(n == m for n in own.values()) for m in (1, 2))
                discount = max(ones / max(ones + 2 * twos, 1), 0.01)
                after = [n for g, n in own.items() if g[:-1] == gram[:-1]]
                if after:
                    chance = max(own[gram] - discount, 0) / sum(after) + discount * len(after) / sum(after) * chance
            total -= math.log(chance)
        return total / (len(p) - ORDER + 1)

    return entropy


def test_cross_entropies_equal_brute_force():
    rows = [("the cat sat on the mat", "en"), ("a cat and a dog", "en"), ("die Katze saß auf der Matte", "de"), ("你好 世界 你好", "zh")]
    done = pd.DataFrame({"text": [t for t, _ in rows], "lang": [x for _, x in rows]})
    frames = [g for _, g in counted(done).groupby("lang")]
    models = Models(pd.concat([_model(g) for g in frames]))
    entropy = brute_models(rows)
    asked = ["the dog", "Katze", "世界 cat", "zzz", "on the mat of der Hund"]
    got, sizes = models.cross_entropies(asked)
    assert sizes.tolist() == [len(letters(t)) for t in asked]
    for text, own in zip(asked, got, strict=True):
        assert own.tolist() == pytest.approx([entropy(text, lang) for lang in models.langs], rel=1e-5)


def counted(done):
    """The counts of ``count_grams``, without Spark."""
    out = []
    for text, lang in zip(done.text, done.lang, strict=True):
        for flat, at, _ in segments([letters(text)], ORDER):
            grams, contexts = _keys(flat, at, ORDER)
            out.append(pd.DataFrame({"lang": lang, **{f"g{k + 1}": g for k, g in enumerate(grams)}, **{f"c{k}": c for k, c in enumerate(contexts) if k}, "n": 1}))
    both = pd.concat(out)
    named = [c for c in both.columns if c != "n"]
    return both.groupby(named, sort=False)["n"].sum().reset_index()


def test_held_out_texts_are_rejected_as_often_as_asked(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    tenth = identify(docs, learn, reject_above=0.9).toPandas()
    held = tenth[tenth.held_out & (tenth.lang_pred != "und")]
    assert 0.02 < held.rejected.mean() < 0.25  # limits from some fifteen texts a language
    rarely = identify(docs, learn).toPandas()  # too few texts for so high a quantile
    assert (rarely.rejected == (rarely.lang_pred == "und")).all()


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = identify(docs, F.lit(True)).toPandas()
    assert len(got) == docs.count() and not got.held_out.any()
    assert got[got.doc_id.isin([1, 2, 3])].lang_pred.tolist() == ["und"] * 3
    assert set(got[got.doc_id == 7].lang_pred) == {"de"}
    assert identify(docs.limit(0), F.lit(True)).count() == 0
    # Nothing to learn from.
    assert set(identify(docs, F.lit(False)).toPandas().lang_pred) == {"und"}


def test_language_is_not_an_input(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = F.col("doc_id") % 2 == 0
    hidden = docs.withColumn("lang", F.when(first, F.col("lang")))
    a, b = (identify(d, first).orderBy("doc_id").toPandas() for d in (docs, hidden))
    assert a.lang_pred.tolist() == b.lang_pred.tolist() and a.score.tolist() == pytest.approx(b.score.tolist())
