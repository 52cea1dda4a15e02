import math
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidewatch.catalog import queries
from tidewatch.catalog.view import transactions
from tidewatch.operators.attribution import linear_attribution, score_linear
from tidewatch.operators.model import (
    TrainConfig,
    encoder_names,
    feature_frame,
    load_model,
    save_model,
    score,
    transform_features,
)
from tidewatch.operators.tree_shap import explain_rows, leaf_tables, node_table, shapley_table, tree_shap, tree_shap_columns, tree_shap_rows
from tidewatch.plans.explain import batch_importance, compare_batches, explain_batch
from tidewatch.plans.training import train_and_evaluate
from tidewatch.schema import TAG_COLUMNS


@pytest.fixture(scope="module")
def txn(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("txn") / "t")
    transactions(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def trained(txn):
    base = txn.where("data_source = 'baseline'").drop(*TAG_COLUMNS)
    return train_and_evaluate(base, TrainConfig(trees=6))


def test_evaluation(trained, txn):
    row = trained.evaluation.first()
    total = txn.where("data_source = 'baseline'").count()
    assert row.test_rows == math.ceil(total / 4) and row.train_rows == total - row.test_rows
    assert row.tp + row.fp + row.fn + row.tn == row.test_rows
    assert 0.5 < row.roc_auc <= 1.0 and row.n_estimators == 6


def test_names_and_unseen_category(spark, trained, txn):
    names = encoder_names(trained.model)
    assert names[-8:] == [c for c in feature_frame(txn).columns if c in names[-8:]]
    odd = txn.limit(1).withColumn("country", F.lit("nowhere")).withColumn("amount", F.lit(None).cast("double"))
    values = dict(zip(names, transform_features(trained.model, odd).first().features))
    assert sum(v for n, v in values.items() if n.startswith("country_")) == 0.0
    assert not math.isnan(values["amount"])
    assert sum(v for n, v in values.items() if n.startswith("channel_")) == 1.0


def test_save_and_load(spark, trained, txn, tmp_path):
    save_model(trained.model, str(tmp_path / "m"))
    rows = txn.limit(20)
    a = score(trained.model, rows).select("score").collect()
    b = score(load_model(str(tmp_path / "m")), rows).select("score").collect()
    assert a == b and all(0 <= r.score <= 1 for r in a)


def test_attributions_add_up_to_the_margin(trained, txn):
    rows = txn.where("data_source = 'production_batch'").limit(300)
    phi = tree_shap_rows(trained.model, rows, ["transaction_id"])
    margin = trained.model.transform(rows).select(
        "transaction_id", F.get(vector_to_array("rawPrediction"), F.lit(1)).alias("m")
    )
    total = F.aggregate("phi", F.lit(0.0), lambda a, v: a + v) + F.col("expected")
    gap = phi.join(margin.dropDuplicates(), "transaction_id").agg(
        F.max(F.abs(total - 2 * F.col("m"))).alias("g"), F.count("*").alias("n")
    )
    row = gap.first()
    assert row.n >= 300 and row.g < 1e-12


def test_attributions_equal_brute_force(spark, trained, txn):
    """Shapley values by enumeration of all subsets of one tree's features."""
    forest = trained.model.stages[-1]
    nodes = node_table(forest, spark)
    first = nodes[nodes.treeID == 0]
    tree, _ = leaf_tables(first, list(forest.treeWeights))
    node = {r.id: r for r in first.itertuples()}
    x = np.array(transform_features(trained.model, txn.limit(1)).first().features)

    def value(known, at=0):
        n = node[at]
        if n.leftChild < 0:
            return 2 * forest.treeWeights[0] * n.prediction
        if n.feature in known:
            v = x[int(n.feature)]
            left = v in n.left if n.categories >= 0 else v <= n.left[0]
            return value(known, n.leftChild if left else n.rightChild)
        share = node[n.leftChild].cover / n.cover
        return share * value(known, n.leftChild) + (1 - share) * value(known, n.rightChild)

    used = sorted({int(r.feature) for r in first.itertuples() if r.leftChild >= 0})
    from tidewatch.operators.tree_shap import attribute

    got = attribute(tree, x[None, :])[0]
    for f in used:
        others = [u for u in used if u != f]
        expected = 0.0
        for size in range(len(others) + 1):
            weight = math.factorial(size) * math.factorial(len(used) - size - 1) / math.factorial(len(used))
            for s in combinations(others, size):
                expected += weight * (value({*s, f}) - value(set(s)))
        assert got[f] == pytest.approx(expected, abs=1e-12)
    assert np.allclose(np.delete(got, used), 0)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(0.01, 1.0), min_size=1, max_size=4), st.floats(-3, 3))
def test_leaf_table_is_efficient(shares, value):
    table = shapley_table(shares, value)
    for pattern, row in enumerate(table):
        met = pattern == 2 ** len(shares) - 1
        assert row.sum() == pytest.approx(value * (met - math.prod(shares)), abs=1e-9)


def test_explanations(trained, txn):
    importance = batch_importance(trained.model, txn, 50)
    names = encoder_names(trained.model)
    assert importance.count() == 6 * len(names)
    assert compare_batches(importance).count() == 5 * len(names)
    one = explain_batch(trained.model, txn, "batch_02_feature_drift.csv", 50)
    assert one.columns == ["feature", "mean_abs_shap_baseline", "mean_abs_shap_drift_batch", "shap_impact_change"]
    assert tree_shap(trained.model, txn.limit(2), ["transaction_id"]).count() == 2 * len(names)


def test_rows_are_explained_largest_first_with_their_values(trained, txn):
    rows = txn.where("data_source = 'baseline'").limit(20).coalesce(1)
    names = encoder_names(trained.model)
    seen = {r.transaction_id: dict(zip(names, r.features)) for r in transform_features(trained.model, rows).collect()}
    phi = {}
    for r in tree_shap(trained.model, rows, ["transaction_id"]).collect():
        phi.setdefault(r.transaction_id, []).append((r.feature, r.phi))
    found = {}
    for r in explain_rows(trained.model, rows, ["transaction_id"], 5).orderBy("rank").collect():
        assert r.value == seen[r.transaction_id][r.feature]
        found.setdefault(r.transaction_id, []).append((r.feature, r.phi))
    assert found == {k: sorted(v, key=lambda x: (-abs(x[1]), names.index(x[0])))[:5] for k, v in phi.items()}
    assert explain_rows(trained.model, rows, ["transaction_id"]).count() == 20 * len(names)


def test_linear_attribution_adds_up(spark):
    df = spark.createDataFrame([(1, 2.0, None), (2, 4.0, 1.0)], "id long, a double, b double")
    weights = {"a": 0.5, "b": -1.0}
    phi = {(r.id, r.feature): r.phi for r in linear_attribution(df, weights, df, ["id"]).collect()}
    assert phi == {(1, "a"): -0.5, (1, "b"): 0.5, (2, "a"): 0.5, (2, "b"): -0.5}
    scores = [r.score for r in score_linear(df, weights, 0.0).orderBy("id").collect()]
    assert scores == [round(1 / (1 + math.exp(-1.0)), 6)] * 2


def test_built_in_attributions_equal_the_arrow_form(trained, txn, spark):
    """All rows, batches with missing and unseen values included, without a Python worker in the plan."""
    keys = ["transaction_id", "batch_file_name"]
    columns = tree_shap_columns(trained.model, txn, keys)
    plan = columns._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInPandas" not in plan and "ArrowEval" not in plan
    got = columns.toPandas().drop_duplicates(keys).set_index(keys).sort_index()
    expected = tree_shap_rows(trained.model, txn, keys).toPandas().drop_duplicates(keys).set_index(keys).sort_index()
    assert len(got) == len(expected) > 0 and (got.index == expected.index).all()
    assert np.abs(np.vstack(got.phi) - np.vstack(expected.phi)).max() < 1e-12
    assert np.abs(np.vstack(expected.phi)).max() > 0.01
    assert (np.vstack(got.features) == np.vstack(expected.features)).all()
    assert tree_shap_columns(trained.model, txn.limit(0), keys).count() == 0


def test_the_query_tree_shap_has_every_row_with_its_attributions(trained, txn, spark, monkeypatch):
    """All rows and copies of them, as many attributions as features, which add up to the row's margin."""
    monkeypatch.setattr(queries, "fitted_model", lambda *_: trained.model)
    monkeypatch.setattr(queries, "transactions", lambda *_: txn)
    found = queries.q_tree_shap(spark, "unused")
    names = encoder_names(trained.model)
    assert found.schema["phi"].metadata["names"] == names == found.schema["features"].metadata["names"]
    keys = ["transaction_id", "batch_file_name"]
    margins = trained.model.transform(txn).select(*keys, F.get(vector_to_array("rawPrediction"), F.lit(1)).alias("m"))
    total = F.aggregate("phi", F.lit(0.0), lambda a, v: a + v) + F.col("expected")
    got = found.where(F.size("phi") == len(names)).select(*keys, F.round(total, 9).alias("m"))
    expected = margins.select(*keys, F.round(2 * F.col("m"), 9).alias("m"))
    close = got.groupBy(*keys).agg(F.count("*").alias("n"), F.max("m").alias("a")).join(
        expected.groupBy(*keys).agg(F.count("*").alias("rows"), F.max("m").alias("b")), keys
    )
    assert got.count() == txn.count()
    assert close.where((F.col("n") != F.col("rows")) | (F.abs(F.col("a") - F.col("b")) > 1e-8)).count() == 0
    assert found.agg(F.max(F.array_max("phi"))).first()[0] > 0.01
    assert found.first().features[names.index("amount")] > 1.0


def test_built_in_attributions_are_compiled_by_parts(trained, txn):
    """Tables are read by compiled terms, not by functions per cell, and the projection stays out of whole-stage code."""
    plan = tree_shap_columns(trained.model, txn, ["transaction_id"])._jdf.queryExecution()
    line = next(x for x in plan.executedPlan().toString().splitlines() if " AS phi#" in x)
    assert "Project [" in line and "*(" not in line
    assert plan.optimizedPlan().toString().count("lambdafunction(") == 2  # one function, its merge and its end
