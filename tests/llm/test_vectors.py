"""Nearest neighbours against all vectors."""

import numpy as np
import pandas as pd

from tests.llm.helpers import frame
from tidewatch.llm.queries import QUERIES
from tidewatch.llm.vectors import BEAM, RATIO, balanced_centroids, nearest, unit


def brute(ids, x, k=5, every=50):
    n = np.sqrt((x * x).sum(axis=1))
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        score = (x * x[i]).sum(axis=1) / (n * n[i])
        order = np.lexsort((ids, -score))
        out[int(ids[i])] = [(int(ids[j]), score[j]) for j in order if j != i][:k]
    return out


def test_query(spark, sf_dir):
    table = pd.read_parquet(f"{sf_dir}/embeddings.parquet")
    expected = brute(table.vec_id.to_numpy(), np.stack(table.embedding).astype(float))
    got = QUERIES["op2_neighbours"](spark, sf_dir).toPandas()
    assert set(got.query_id) == set(expected)
    hits = 0
    for query, own in got.sort_values("rank").groupby("query_id"):
        assert own["rank"].tolist() == [1, 2, 3, 4, 5]
        order = list(zip(-own.score, own.vec_id, strict=True))
        assert order == sorted(order)
        hits += len({v for v, _ in expected[query]} & set(own.vec_id))
    assert hits >= 0.9 * 5 * len(expected)


def test_ties_among_many_copies(spark):
    """A third of all vectors alike: its list is read in pieces, and ties go to the smaller ids."""
    random = np.random.default_rng(3)
    x = random.normal(size=(9000, 16))
    x[::3] = x[0]
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    got = nearest(frame(spark, rows, "vec_id long, embedding array<double>"), every=300).toPandas()
    expected = brute(np.arange(9000), x, every=300)
    hits = 0
    for query, own in got.groupby("query_id"):
        mine = own.sort_values("rank").vec_id.tolist()
        if query % 3 == 0:
            assert mine == [v for v, _ in expected[query]]
        hits += len(set(mine) & {v for v, _ in expected[query]})
    assert hits >= 0.9 * 5 * len(expected)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, [2.0, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0]),
        (None, [1.0, 1.0]), (50, [0.0, 1.0]), (50, [0.0, 1.0]), (100, None),
    ]
    table = frame(spark, rows, "vec_id long, embedding array<double>").selectExpr("*", "'c' AS list", "1 AS v", "2 AS rank")
    got = [tuple(r)[:3] for r in nearest(table).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 50), (50, 1, 1), (50, 2, 0)]
    assert nearest(table.limit(0)).count() == 0
    assert nearest(table.where("vec_id = 0")).count() == 0


def test_the_graph_finds_the_nearest_centroid():
    random = np.random.default_rng(4)
    sample = unit(random.normal(size=(3000, 24)))
    centroids = balanced_centroids(sample, 150)
    queries = unit(random.normal(size=(200, 24)))
    ids, dist = centroids.search(queries)
    assert (np.diff(dist, axis=1) >= 0).all()
    assert (ids[:, 0] == (queries @ centroids.points.T).argmax(axis=1)).mean() > 0.95


def test_the_ratio_decides_however_many_lists_lie_within_it():
    random = np.random.default_rng(5)
    centroids = balanced_centroids(unit(random.normal(size=(4000, 64))), 400)
    queries = unit(random.normal(size=(50, 64)))
    gaps = np.sqrt(2 - 2 * queries @ centroids.points.T)
    within = [set(np.flatnonzero(g <= RATIO * 0.999 * g.min())) for g in gaps]
    assert min(len(w) for w in within) > BEAM
    assert all(w <= set(p) for w, p in zip(within, centroids.probes(queries), strict=True))
