"""Mixing against the same rules in plain Python."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents, frame, odd_documents
from tidewatch.llm.mixing import BLOCK, UNIT, mix, sample, source_targets
from tidewatch.llm.queries import QUERIES


def hashed(text, digits):
    return int(hashlib.sha256(text.encode()).hexdigest()[:digits], 16)


def shares(sizes, weights=(5, 2, 1), most=3):
    """Targets as the rule says it: share by weight, stop at the limit, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, full = {}, set()
    while True:
        left = sum(sizes.values()) - sum(most * sizes[s] for s in full)
        open_ = sum(weight[s] for s in order if s not in full)
        target = {s: most * sizes[s] if s in full else left * weight[s] / open_ for s in order}
        above = {s for s in order if s not in full and target[s] >= most * sizes[s]}
        if not above or full | above == set(order):
            return target | {s: float(most * sizes[s]) for s in above}
        full |= above


def brute(rows, seed, bucket_rows=10_000):
    """Copies of (doc_id, text, source) rows, in the order given."""
    size = [len(re.findall("[^\x20\x09-\x0d]+", t or "")) for _, t, _ in rows]
    sizes = Counter()
    for (_, _, s), n in zip(rows, size, strict=True):
        sizes[s] += n
    target = shares(sizes)
    many = Counter((s, n // BLOCK) for (_, _, s), n in zip(rows, size, strict=True))
    lines = defaultdict(list)
    for k, (doc_id, _, s) in enumerate(rows):
        place, block = hashed(f"{seed}:{'' if doc_id is None else doc_id}", 15), size[k] // BLOCK
        parts = math.ceil(many[s, block] / bucket_rows) if many[s, block] > bucket_rows else 1
        lines[s].append((block, (place >> 30) * parts >> 30, size[k], place, k))
    copies = [0] * len(rows)
    for s, line in lines.items():
        rate = min(math.floor(target[s] / sizes[s] * UNIT), 3 * UNIT) if sizes[s] else 0
        at = hashed(f"{seed}:{'n' if s is None else 's' + s}", 8)
        for *_, k in sorted(line):
            copies[k], at = (at + rate) // UNIT - at // UNIT, at + rate
    return copies, size, sizes, target


def made(n):
    """Four sources and none; one holds a third of all rows, most of them of one size."""
    out = []
    for i in range(n):
        source = "abcd"[hashed(f"s{i}", 4) % 4] if i % 3 else "hot"
        words = 7 if i % 3 == 0 and i % 4 else hashed(f"w{i}", 4) % 300
        out.append((i, " \n".join(["w"] * words), None if i % 17 == 0 else source))
    return out


@pytest.mark.parametrize("bucket_rows", [10, 10_000])
def test_copies_equal_the_plain_rule(spark, bucket_rows):
    rows = made(3_000)
    got = sample(frame(spark, rows, "doc_id long, text string, source string"), seed=4, bucket_rows=bucket_rows).toPandas().sort_values("doc_id")
    copies, size, sizes, target = brute(rows, 4, bucket_rows)
    assert got.copies.tolist() == copies and got["size"].tolist() == size
    assert got.taken.tolist() == [c * n for c, n in zip(copies, size, strict=True)]
    assert got.source_size.tolist() == [sizes[s] for _, _, s in rows]
    assert got.target.tolist() == pytest.approx([target[s] for _, _, s in rows], rel=1e-12)
    taken = Counter()
    for (_, _, s), words in zip(rows, got.taken, strict=True):
        taken[s] += words
    assert all(abs(taken[s] - target[s]) <= 2 * max(size) + BLOCK * len(rows) / bucket_rows for s in sizes)


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10_000, "c": 3}, {"a": 1, "b": 1, "c": 1, "d": 1}, {"a": 0, "b": 5, None: 2}, {"a": 0}, {None: 4}, {"a": 1, "b": 8, "c": 1, "d": 90, "e": 400}])
def test_targets_stop_at_three_times_the_size(spark, sizes):
    got = source_targets(frame(spark, list(sizes.items()), "source string, source_size long"), 0).collect()
    assert {r.source: r.target for r in got} == pytest.approx(shares(sizes), rel=1e-12)
    assert sum(r.target for r in got) == pytest.approx(sum(sizes.values()))


def test_query_runs_no_python_and_keeps_near_its_targets(spark, sf_dir):
    found = QUERIES["op13_mixing"](spark, sf_dir)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    docs, got = documents(sf_dir), found.toPandas()
    both = got.merge(docs[["doc_id", "source"]], on="doc_id")
    assert len(both) == len(docs) and (both.taken <= 3 * both["size"]).all()
    for _, own in both.groupby("source"):
        assert abs(own.taken.sum() - own.target.iloc[0]) <= 2 * own["size"].max()
    again = QUERIES["op13_mixing"](spark, sf_dir).toPandas()
    assert sorted(got.itertuples(index=False)) == sorted(again.itertuples(index=False))


def test_the_mix_repeats_whole_rows(spark):
    rows = made(400) + [(1, "twice the same", "a")] * 2
    docs = frame(spark, rows, "doc_id long, text string, source string").withColumn("copies", F.lit("clash"))
    expected = Counter()
    for (doc_id, text, source), n in zip(rows, brute(rows, 2)[0], strict=True):
        expected[doc_id, text, source] += n
    got = Counter((r.doc_id, r.text, r.source) for r in mix(docs, seed=2).collect())
    assert got == +expected and mix(docs, seed=2).columns == [*docs.columns, "copy"]


def test_odd_rows(spark):
    docs = odd_documents(spark).selectExpr("* EXCEPT (lang)", "lang AS source", "1 AS size", "2 AS place", "3 AS rate")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    got = sample(docs, seed=1).collect()
    copies, size, sizes, _ = brute(rows, 1)
    key = lambda r: tuple((v is not None, v) for v in r)
    mine = sorted(((r.doc_id, r.source, r.size, r.copies) for r in got), key=key)
    assert mine == sorted(((i, s, n, c) for (i, _, s), n, c in zip(rows, size, copies, strict=True)), key=key)
    assert sample(docs.limit(0), seed=1).count() == 0 and mix(docs.limit(0)).count() == 0
    assert {r.taken for r in sample(docs.where("doc_id IN (1, 2, 3)"), seed=1).collect()} == {0}
