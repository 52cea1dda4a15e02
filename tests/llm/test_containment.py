"""Benchmark items in documents against counting on the words."""

import pandas as pd

from tests.llm.helpers import documents, frame, odd_documents, shingles, words
from tidewatch.llm.containment import contaminated
from tidewatch.llm.queries import QUERIES


def brute(docs, items):
    out = set()
    for item, text in items:
        asked = shingles(text)
        n = min(5, len(words(text)))
        for i, t in docs:
            w = words(t)
            shared = len(asked & set(zip(*[w[k:] for k in range(n)]))) if n else 0
            if asked and shared >= 0.8 * len(asked) - 1e-9:
                out.add((i, item, len(asked), shared))
    return out


def rows(df):
    return {(r.doc_id, r.item_id, r.shingles, r.shared) for r in df.collect()}


def test_query(spark, sf_dir):
    docs, items = documents(sf_dir), pd.read_parquet(f"{sf_dir}/benchmark.parquet")
    found = QUERIES["op7_decontamination"](spark, sf_dir)
    got = found.toPandas()
    assert len(got) == len(got[["doc_id", "item_id"]].drop_duplicates())
    expected = brute(list(zip(docs.doc_id, docs.text, strict=True)), list(zip(items.item_id, items.text, strict=True)))
    assert rows(found) == expected and expected


def test_only_built_in_functions(spark, sf_dir):
    plan = QUERIES["op7_decontamination"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))


def test_long_documents_and_short_items(spark):
    filler = " ".join(f"word{i}" for i in range(30_000))
    items = [(1, "an item of just five"), (2, "Two words"), (3, "one"), (4, None), (5, " \n"), (6, "a b c d e f g h i j"), (7, "x y " * 30)]
    docs = [(1, f"{filler} an\nITEM of just\tfive {filler}"), (2, "two  words here"), (3, "a b c d e f g h i k"), (4, "a b c d e f g h k"),
            (5, "x y x y x y x"), (6, "the one"), (7, ""), (8, None)]
    got = contaminated(frame(spark, docs, "doc_id long, text string"), frame(spark, items, "item_id long, text string"))
    assert rows(got) == brute(docs, items)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    items = frame(spark, [(None, "the same row twice is still"), (1, "x" * 200_000), (1, "line one line three")], "item_id long, text string")
    got = contaminated(docs, items)
    assert rows(got) == {(5, None, 2, 2), (6, 1, 1, 1), (7, 1, 1, 1)}
    assert contaminated(docs.limit(0), items).count() == 0 and contaminated(docs, items.limit(0)).count() == 0
