"""Line dedup against a count of all lines."""

import hashlib
from collections import defaultdict

import pytest

from tests.llm.helpers import LOW, documents, frame, odd_documents
from tidewatch.llm import line_dedup
from tidewatch.llm.line_dedup import dedup_lines
from tidewatch.llm.queries import QUERIES

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def brute(rows, least, documents):
    """(kept text, lines, dropped) of each (doc_id, text); ids are all given."""
    key = lambda line: line.strip(SPACE).translate(LOW)
    holders = defaultdict(list)
    for i, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= least:
                holders[k].append(i)
    keeper = {k: max(v) for k, v in holders.items() if len(v) >= documents}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if keeper.get(key(x), i) == i]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_query(spark, sf_dir):
    docs = documents(sf_dir)
    got = QUERIES["op1_line_dedup"](spark, sf_dir).toPandas().set_index("doc_id")
    for i, (text, n, dropped) in zip(docs.doc_id, brute(list(zip(docs.doc_id, docs.text, strict=True)), 40, 5), strict=True):
        assert tuple(got.loc[i]) == (n, dropped, hashlib.sha256(text.encode()).hexdigest())


@pytest.mark.parametrize("keys", [1, 3, 1 << 14])
def test_frequent_lines(spark, monkeypatch, keys):
    """Lines of one row in two, of some rows and of five: looked up where they are or joined, the same goes."""
    monkeypatch.setattr(line_dedup, "HOT_KEYS", keys)
    rows = [(i, "\n".join([f"own line {i:04}", *("everywhere" for _ in range(i % 2 * 2)), f"line of {i % 7:04}", f"line of five {i // 5:04}"])) for i in range(300)]
    got = {(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in dedup_lines(frame(spark, rows, "doc_id long, text string"), 8, 5).collect()}
    assert got == {(i, *x) for (i, _), x in zip(rows, brute(rows, 8, 5), strict=True)}


def test_small_cases(spark):
    rows = [
        (1, "Shared LINE\nown one"), (2, "  shared line\t\nshared line\nown two"), (3, "SHARED line"), (3, "shared line\nthree"),
        (4, "é" * 8 + "\nshort"), (5, "\t" + "é" * 8 + "\r"), (6, "É" * 8), (7, None), (8, "x\n\n\n"), (9, "shared lines"),
    ]
    got = {(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in dedup_lines(frame(spark, rows, "doc_id long, text string"), 8, 2).collect()}
    assert got == {(i, *x) for (i, _), x in zip(rows, brute(rows, 8, 2), strict=True)}


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = dedup_lines(docs, 4, 2)
    assert got.count() == docs.count() and set(got.columns) == set(docs.columns)
    assert dedup_lines(docs.limit(0), 4, 2).count() == 0
    # Where no row has an id, all keep the line; where one has, it is the keeper.
    none = frame(spark, [(None, "the line"), (None, "the line")], "doc_id long, text string")
    assert [r.n_dropped for r in dedup_lines(none, 4, 2).collect()] == [0, 0]
    some = none.union(frame(spark, [(1, "the line")], "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.n_dropped) for r in dedup_lines(some, 4, 2).collect()) == [(0, 1), (0, 1), (1, 0)]
