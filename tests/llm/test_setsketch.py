"""Near-duplicate groups against all pairs."""

import random

import numpy as np

from tests.llm.helpers import documents, frame, odd_documents, shingles
from tidewatch.llm.queries import QUERIES
from tidewatch.llm.setsketch import estimate, near_duplicates, registers, shingle_sets


def brute(rows, percent):
    """The smallest id reachable from each row; all ids differ."""
    ids, sets = [i for i, _ in rows], [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            small, large = sorted((len(sets[a]), len(sets[b])))
            if small and 100 * small >= percent * large:
                shared = len(sets[a] & sets[b])
                if 100 * shared >= percent * (small + large - shared):
                    parent[root(a)] = root(b)
    least = {}
    for k, i in enumerate(ids):
        least[root(k)] = min(i, least.get(root(k), i))
    return {i: (len(sets[k]), least[root(k)]) for k, i in enumerate(ids)}


def check(got, expected):
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_query(spark, sf_dir):
    docs = documents(sf_dir)
    check(QUERIES["op8_near_dedup"](spark, sf_dir).collect(), brute(list(zip(docs.doc_id, docs.text, strict=True)), 85))


def test_chains_and_crowded_buckets(spark):
    """Copies of one text with more and more changes: many pairs near the threshold, on either side."""
    random.seed(4)
    rows = []
    for group in range(3):
        base = [f"g{group}w{random.randint(0, 10**6)}" for _ in range(120)]
        for k in range(60):
            own = base[:]
            for _ in range(random.choice([0, 1, 2, 3, 4, 6])):
                own[random.randrange(len(own))] = f"new{random.randint(0, 10**9)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(1000 + k, " ".join(f"c{i}" for i in range(3 * k, 3 * k + 100))) for k in range(40)]  # a chain
    check(near_duplicates(frame(spark, rows, "doc_id long, text string"), 85).collect(), brute(rows, 85))


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = near_duplicates(docs).toPandas()
    assert len(got) == docs.count()
    same = got[(got.doc_id == 5)]
    assert len(same) == 3 and same.kept.all() and same.group_id.nunique() == 2
    assert got[got.doc_id.isin([1, 2, 3])].n_shingles.tolist() == [0, 0, 0] and got[got.doc_id == 4].n_shingles.tolist() == [1]
    assert near_duplicates(docs.limit(0)).count() == 0
    short = frame(spark, [(1, "a b c"), (2, "A  b\nC"), (3, "a b"), (4, ""), (5, "")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in near_duplicates(short).collect()) == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 5)]


def test_sets_are_the_words_own():
    random.seed(5)
    texts = ["", " ", "a", "a b c d", "a b c d e", "a b c d e " * 30, *(" ".join(random.choices("abc", k=random.randint(1, 60))) for _ in range(200))]
    hashed, ends = shingle_sets([t.encode() for t in texts])
    assert np.diff(ends, prepend=0).tolist() == [len(shingles(t)) for t in texts]


def test_estimate_follows_similarity():
    random.seed(6)
    base = [f"w{i}" for i in range(1000)]
    for shared in (300, 600, 900):
        other = base[:shared] + [f"v{i}" for i in range(1000 - shared)]
        a, b = (shingle_sets([" ".join(x).encode()]) for x in (base, other))
        true = len(shingles(" ".join(base)) & shingles(" ".join(other)))
        true /= len(shingles(" ".join(base)) | shingles(" ".join(other)))
        sizes = [np.array([len(x[0])]) for x in (a, b)]
        assert abs(estimate(registers(*a), registers(*b), *sizes)[0] - true) < 0.13


def test_registers_of_a_union_are_the_larger_ones():
    a, b = (shingle_sets([" ".join(f"w{i}" for i in r).encode()])[0] for r in (range(300), range(200, 600)))
    union = np.unique(np.concatenate([a, b]))
    one = lambda x: registers(x, np.array([len(x)]))
    assert (np.maximum(one(a), one(b)) == one(union)).all()
