"""Tables of neighbouring leaves against the leaves one by one; sums of a task against plain ones."""

import numpy as np
import pyarrow as pa

from tidewatch.operators.boosting import _Sums
from tidewatch.operators.tree_shap import _largest, _pattern, _ranks, answer_tables, attribute, shapley_table


def tree(depth, seed):
    rng, tests, leaves = np.random.default_rng(seed), {}, []

    def grow(path, left):
        at = len(tests) + len(leaves)
        if not left:
            by = {}
            for test, side, share in path:
                by.setdefault(tests[test][0], []).append((test, side, share))
            shares = [float(np.prod([s for *_, s in steps])) for steps in by.values()]
            sides = [[(t, side) for t, side, _ in steps] for steps in by.values()]
            leaves.append((list(by), sides, shapley_table(shares, rng.normal())))
            return
        f = int(rng.integers(0, 4))
        tests[at] = (f, np.array([1.0, 3.0]), 4) if f == 3 else (f, np.array([rng.random()]), -1)
        for side in (False, True):
            grow([*path, (at, side, rng.random())], left - 1)

    grow([], depth)
    return tests, leaves


def one_by_one(trees, x):
    phi = np.zeros_like(x)
    for tests, leaves in trees:
        left = {at: np.isin(x[:, f], cut) if k >= 0 else x[:, f] <= cut[0] for at, (f, cut, k) in tests.items()}
        for features, sides, table in leaves:
            phi[:, features] += table[_pattern(sides, left, len(x))]
    return phi


def test_tables_equal_the_leaves():
    rng = np.random.default_rng(1)
    x = rng.random((5000, 6))
    x[:, 3] = rng.integers(0, 5, 5000)
    for trees in ([tree(4, s) for s in range(5)], [tree(9, 7)], [tree(0, 1)], []):
        assert np.abs(attribute(trees, x) - one_by_one(trees, x)).max() < 1e-9
    _, groups, deep = answer_tables([tree(4, 3)])
    assert len(groups) == 2 and not deep  # of 16 leaves
    assert answer_tables([tree(9, 7)])[2]


def test_largest_and_ranks():
    size = np.array([[1.0, 3.0, 3.0, 0.0], [0.0, 0.0, 0.0, 0.0]])
    assert _largest(size, 3).tolist() == [[1, 2, 0], [0, 1, 2]]
    assert _ranks(size, [0, 2]).tolist() == [[3, 2], [1, 3]]


def test_sums_are_whole_however_large():
    sums = _Sums([2, 3], 2, pa.string())
    big = 2**60 + 1
    for _ in range(2):
        sums.add(np.array([4, 4, 7]), np.array([big, 1, -3]), np.array([1, 2, 3]), pa.array(["a", None, "b", "x", "a", None]))
    rows = sorted(map(str, (tuple(r.values()) for r in sums.emptied().to_pylist())))
    assert rows == sorted(map(str, [
        (4, 2, 0, "a", 2, 2 * big, 2), (4, 2, 0, "b", 2, 2, 4), (7, 2, 0, "a", 2, -6, 6),
        (4, 3, 0, None, 2, 2 * big, 2), (4, 3, 0, "x", 2, 2, 4), (7, 3, 0, None, 2, -6, 6),
    ]))
    assert sums.emptied().num_rows == 0
