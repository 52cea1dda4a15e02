"""Boosted trees against a brute-force search of every split."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.catalog.view import transactions
from tidewatch.operators.boosting import (
    UNIT,
    BoostConfig,
    Node,
    _blocks,
    _Layout,
    _level,
    _moved_on,
    binned,
    fit_boosted,
    gradients,
    level_histogram,
    load_boosted,
    model_nodes,
    quantile_cuts,
    save_boosted,
    score_boosted,
    train_boosted,
    tree_value,
    went_left,
)
from tidewatch.operators.drift import numeric_features
from tidewatch.operators.performance import roc_auc
from tidewatch.plans.training import EVALUATION_METRICS, EVALUATION_PARAMS, save_run, train_and_evaluate
from tidewatch.schema import BATCH_COLUMN, TAG_COLUMNS, TARGET

ALL = {"row_fraction": 1.0, "column_fraction": 1.0}


def units(x):
    return math.floor(abs(x) * UNIT + 0.5) * (1 if x >= 0 else -1)


def brute(rows, names, numbers, config):
    """The trees of (values, label) rows: every value as a threshold, both directions, level by level."""
    pos = sum(y for _, y in rows)
    weight = (len(rows) - pos) / pos if pos else 1.0
    margins, trees = [0.0] * len(rows), []
    for _ in range(config.trees):
        g, h = [], []
        for (_, y), m in zip(rows, margins, strict=True):
            p, w = 1 / (1 + math.exp(-m)), weight if y else 1.0
            g.append(units(w * (p - y)))
            h.append(units(w * p * (1 - p)))
        tree = {}

        def part(own):
            a, b = sum(g[i] for i in own) / UNIT, sum(h[i] for i in own) / UNIT
            return a * a / (b + config.penalty)

        def grow(node, own, depth):
            value = -config.learning_rate * (sum(g[i] for i in own) / UNIT) / (sum(h[i] for i in own) / UNIT + config.penalty)
            best = None
            for k, name in enumerate(names if depth < config.depth else []):
                here = [rows[i][0][k] for i in own]
                if k < numbers:
                    tried = [(v, d) for v in sorted({v for v in here if v is not None}) for d in (True, False)]
                    goes = lambda v, cut: cut[1] if v is None else v <= cut[0]
                else:
                    tried = sorted(set(here), key=lambda v: (v is not None, v))
                    goes = lambda v, cut: v != cut
                for cut in tried:
                    left = [i for i in own if goes(rows[i][0][k], cut)]
                    right = [i for i in own if not goes(rows[i][0][k], cut)]
                    if min(sum(h[i] for i in left), sum(h[i] for i in right)) < config.least_weight * UNIT:
                        continue
                    gain = part(left) + part(right) - part(own)
                    heavier = k >= numbers or cut[1] == (sum(h[i] for i in left) >= sum(h[i] for i in right))
                    if best is None or gain > best[0] or gain == best[0] and best[1:3] == (k, cut[0] if k < numbers else cut) and heavier:
                        best = (gain, k, cut[0] if k < numbers else cut, cut, left, right)
            if best is None or best[0] <= config.least_gain:
                tree[node] = (None, None, value)
                for i in own:
                    margins[i] += value
                return
            missing = any(rows[i][0][best[1]] is None for i in own)
            tree[node] = (names[best[1]], best[3] if best[1] >= numbers else (best[2], best[3][1] if missing else None), value)
            grow(2 * node, best[4], depth + 1)
            grow(2 * node + 1, best[5], depth + 1)

        grow(1, list(range(len(rows))), 0)
        trees.append(tree)
    return trees, [1 / (1 + math.exp(-m)) for m in margins]


def made(seed, n=300):
    draw = random.Random(seed)
    out = []
    for _ in range(n):
        a = None if draw.random() < 0.3 else float(draw.randint(0, 6))
        b = None if draw.random() < 0.1 else draw.randint(0, 4) / 2
        c = draw.choice(["x", "y", "z", None])
        hit = (a is None) * 1.5 + (b or 0) + (c == "z") * 1.2 - (c is None) + draw.gauss(0, 0.8)
        out.append(((a, b, c), int(hit > 1.6)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_splits_equal_a_search_of_all(spark, seed):
    rows = made(seed)
    config = BoostConfig(trees=4, depth=3, learning_rate=0.3, written_every=2, **ALL)
    df = spark.createDataFrame([(*v, y) for v, y in rows], "a double, b double, c string, label_fraud int")
    cuts = {k: sorted({v[i] for v, _ in rows if v[i] is not None}) for i, k in enumerate("ab")}
    model = fit_boosted(df, ["a", "b"], ["c"], config=config, cuts=cuts)
    expected, scores = brute(rows, ["a", "b", "c"], 2, config)
    missing_seen = 0
    for nodes, tree in zip(model.trees, expected, strict=True):
        assert {n.node for n in nodes} == set(tree)
        for n in nodes:
            name, cut, value = tree[n.node]
            assert n.column_name == name and n.value == pytest.approx(value, abs=1e-9)
            if name == "c":
                assert n.category == cut
            elif name:
                assert n.threshold == cut[0]
                if cut[1] is not None:
                    assert n.missing_left == cut[1]
                    missing_seen += 1
    assert missing_seen
    got = [r.score for r in score_boosted(model, df.coalesce(1)).collect()]
    assert got == pytest.approx(scores, abs=1e-9)


def test_a_missing_cell_goes_where_its_like_went(spark):
    """Missing means fraud here, whatever the mean of the others says."""
    rows = [(float(i % 10), 0) for i in range(200)] + [(None, 1)] * 60 + [(float("nan"), 1)] * 20
    df = spark.createDataFrame(rows, "a double, label_fraud int")
    model = fit_boosted(df, ["a"], [], config=BoostConfig(trees=8, depth=2, learning_rate=0.5, **ALL))
    ask = spark.createDataFrame([(None,), (float("nan"),), (4.5,)], "a double")
    missing, nan, known = (r.score for r in score_boosted(model, ask).collect())
    assert missing == nan > 0.8 and known < 0.2


def test_rows_that_teach_nothing(spark):
    schema = "a double, c string, label_fraud int"
    for rows in ([], [(1.0, "x", 1)], [(None, None, 0)] * 5, [(None, "x", None)], [(1.0, "x", 0), (2.0, "y", 0)]):
        df = spark.createDataFrame(rows, schema)
        model = fit_boosted(df, ["a"], ["c"], config=BoostConfig(trees=2, **ALL))
        assert all(len(t) == 1 for t in model.trees)
        assert score_boosted(model, df).count() == len(rows)


def test_transactions_and_the_stored_model(spark, sf_dir, tmp_path):
    base = transactions(spark, sf_dir).where("data_source = 'baseline'")
    config = BoostConfig(trees=3, depth=3, learning_rate=0.5)
    cuts = quantile_cuts(base, numeric_features(base), 32)
    model = train_boosted(base, config, cuts)
    assert train_boosted(base.repartition(5), config, cuts) == model  # however the rows are dealt
    scored = score_boosted(model, base)
    assert roc_auc(scored).first()["roc_auc"] > 0.9
    save_boosted(spark, model, str(tmp_path / "m"))
    assert load_boosted(spark, str(tmp_path / "m")) == model
    assert model_nodes(spark, model).where("column_name IS NOT NULL").count() > 5
    many = train_boosted(base.limit(300), BoostConfig(trees=40, depth=1, written_every=20))
    assert score_boosted(many, base.limit(10)).where(F.col("score").between(0, 1)).count() == 10
    assert {BATCH_COLUMN, TARGET} < set(scored.columns)


def test_a_run_leaves_model_table_and_log(spark, sf_dir, tmp_path):
    base = transactions(spark, sf_dir).where("data_source = 'baseline'").drop(*TAG_COLUMNS)
    result = train_and_evaluate(base, boosting=BoostConfig(trees=3, depth=2))
    row = result.evaluation.first()
    assert row.n_estimators == 3 and row.max_depth == 2 and row.test_rows == math.ceil(base.count() / 4)
    save_run(spark, result, str(tmp_path / "run"))
    assert load_boosted(spark, str(tmp_path / "run/model")) == result.model
    table = spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "run/confusion"))
    assert sum(r.Predicted_0 + r.Predicted_1 for r in table.collect()) == row.test_rows
    log = {r.key for r in spark.read.parquet(str(tmp_path / "run/log")).collect()}
    assert log == {*EVALUATION_PARAMS, *EVALUATION_METRICS}


def test_blocks_give_the_sums_of_the_rows(spark, sf_dir):
    """A level from blocks equals that from rows, with the draw and the gradients as Spark's functions have them."""
    odd = F.when(F.col("amount") > 1500, F.lit(float("nan"))).otherwise(F.col("login_velocity_24h"))
    txn = transactions(spark, sf_dir).where("transaction_hour < 12").withColumn("login_velocity_24h", odd).withColumn("channel", F.when(F.col("amount") > 2000, F.col("channel")))
    columns, categories = numeric_features(txn), ["channel", "country"]
    cuts = quantile_cuts(txn, columns, 16) | {"transaction_hour": [float(c) for c in range(300)]}
    names = [*columns, *categories]
    rows = binned(txn.select(*names, TARGET), cuts, categories, TARGET, F.when(F.col(TARGET) == 1, 7.5).otherwise(1.0), 5).cache()
    layout = _Layout(tuple(columns), tuple(categories), "u2", 7.5, 0.9)
    blocks = _blocks(txn.repartition(3), cuts, TARGET, 5, layout)
    assert blocks.count() <= 6 and blocks.agg(F.sum("n")).first()[0] == rows.count()
    splits = [("amount", 7.0, None, True, False), ("channel", None, None, False, False), ("ip_risk_score", 3.0, None, True, True)]
    tree = {i + 1: Node(0, i + 1, c, v, k, n, m, 0.0, 1.0, 1.0) for i, (c, v, k, n, m) in enumerate(splits)}
    leaves = {i: Node(0, i, None, None, None, False, False, i / 7 - 0.8, 0.0, 1.0) for i in range(4, 8)}

    def value(node):
        at = names.index(node.column_name)
        return F.nullif(F.get("bins", F.lit(at)), F.lit(-1)) if node.is_number else F.get("categories", F.lit(at - len(columns)))

    first, now = tree | leaves, {1: tree[3], 2: leaves[4]}
    drawn = rows.where(F.pmod(F.xxhash64("key", F.lit(11)), F.lit(1 << 20)) < int(0.9 * (1 << 20)))
    placed = drawn.withColumn("node", F.when(went_left(tree[3], value(tree[3])), 2).otherwise(3)).where("node = 3")
    expected = level_histogram(gradients(placed, F.col("margin") + tree_value(first, value)), [0, 2, *range(5, len(names))], len(columns))
    moved = _moved_on(blocks, layout, [first])
    for got in (_level(blocks, layout, [0, 2, *range(5, len(names))], 11, [first], now), _level(moved, layout, [0, 2, *range(5, len(names))], 11, [], now)):
        assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))
    assert expected.count() > 50
