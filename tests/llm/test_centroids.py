"""Whole-number k-means against full scans."""

import hashlib

import numpy as np
import pytest

from tests.llm.helpers import frame
from tidewatch.llm.centroids import VantageTree, cluster, described


def nearest(x, points):
    gaps = ((x[:, None] - points[None]) ** 2).sum(axis=2)
    return gaps.argmin(axis=1), gaps.min(axis=1)  # argmin takes the first of equal ones


def brute(ids, vectors, count, rounds, seed=3, scale=1024):
    x = np.array([[int(np.floor(scale * float(v))) for v in row] for row in vectors], np.int64)
    names = [hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest() for i in ids]
    order = sorted(range(len(ids)), key=lambda k: (names[k], x[k].tolist()))
    points = x[order[:count]].copy()
    for _ in range(rounds):
        own, _ = nearest(x, points)
        for k in range(len(points)):
            if (own == k).any():
                points[k] = [int(s) // int((own == k).sum()) for s in x[own == k].sum(axis=0)]
    return *nearest(x, points), points


@pytest.mark.parametrize("leaf", [1, 2, 5])
@pytest.mark.parametrize("count", [1, 2, 3, 8, 150])
def test_the_tree_finds_what_a_full_scan_finds(count, leaf):
    random = np.random.default_rng(count)
    for spread in (2, 50, 1 << 27):  # with few values there are many ties and equal centroids
        points = random.integers(-spread, spread, (count, 4))
        x = np.concatenate([random.integers(-spread, spread, (500, 4)), points])
        own, gap = VantageTree(points, leaf).nearest(x)
        expected = nearest(x, points)
        assert (own == expected[0]).all() and (gap == expected[1]).all()


def test_most_nodes_stay_shut_where_centroids_lie_apart():
    random = np.random.default_rng(1)
    points = random.integers(-10_000, 10_000, (512, 2))
    tree, opened_ = VantageTree(points), []
    plain = tree.squared
    tree.squared = lambda x, ids: opened_.append(len(x) * len(ids)) or plain(x, ids)
    tree.nearest(points[:200] + 3)
    assert sum(opened_) < 200 * 512 / 4


def test_rounds_equal_full_scans(spark):
    random = np.random.default_rng(5)
    x = (random.normal(size=(900, 6)) + random.integers(0, 4, (900, 1))).astype(np.float32)
    x[::3] = x[0]  # a third of all rows alike
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    assigned, points = cluster(frame(spark, rows, "vec_id long, embedding array<float>"), count=5, rounds=4, length=6)
    got = described(assigned, points).toPandas().sort_values("vec_id")
    own, gap, expected = brute(range(900), x, 5, 4)
    assert (points == expected).all() and got.cluster.tolist() == own.tolist() and got.distance.tolist() == gap.tolist()
    assert (got.inertia == gap.sum()).all()
    assert all(r.cluster_inertia == gap[own == r.cluster].sum() for r in got.itertuples())
    names = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in expected.tolist()]
    assert got.centroid_sha256.tolist() == [names[k] for k in own]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.5, -0.25]), (1, [0.5, -0.25]), (None, [3.0, 4.0]), (2, [-0.0001, 1e-9]), (3, [131071.0, -131071.0])]
    bad = [(4, None), (5, []), (6, [1.0]), (7, [1.0, None]), (8, [nan, 1.0]), (9, [inf, 1.0]), (10, [1e30, 1.0]), (11, [1.0, 2.0, 3.0])]
    table = frame(spark, good + bad, "vec_id long, embedding array<double>").selectExpr("*", "7 AS cluster", "'c' AS distance", "1 AS c")
    assigned, points = cluster(table, count=8, rounds=3, length=2)
    got = sorted((r.vec_id or 0, r.cluster, r.distance) for r in described(assigned, points).collect())
    own, gap, expected = brute([i for i, _ in good], [v for _, v in good], 8, 3)
    assert len(points) == 5 and (points == expected).all()
    assert got == sorted((i or 0, int(k), int(d)) for (i, _), k, d in zip(good, own, gap, strict=True))
    assert described(*cluster(table.limit(0), length=2)).count() == 0
    assert described(*cluster(table.where("vec_id > 3"), length=2)).count() == 0
