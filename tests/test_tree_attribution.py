"""Exact tree attributions against the sum over all feature sets."""

from __future__ import annotations

import itertools
from math import factorial

import numpy as np
import pytest
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from parcelytics.operators import features, modelling, tree_attribution

COLUMNS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    a, b, c = rng.normal(size=400), rng.integers(0, 5, 400).astype(float), rng.random(400)
    y = np.where(a > 0.2, 3 * b, c) + a * c + rng.normal(size=400) / 10
    rows = [(i, *map(float, v)) for i, v in enumerate(zip(a, b, c, rng.random(400), y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y double")


def expectation(nodes, known, x, at=0):
    """Mean prediction of one saved tree when only the features in `known` are given."""
    node = nodes[at]
    if node["leftChild"] < 0:
        return node["prediction"]
    feature, limit = node["split"]["featureIndex"], node["split"]["leftCategoriesOrThreshold"][0]
    left, right = node["leftChild"], node["rightChild"]
    if feature in known:
        return expectation(nodes, known, x, left if x[feature] <= limit else right)
    n, m = nodes[left]["impurityStats"][0], nodes[right]["impurityStats"][0]
    return (n * expectation(nodes, known, x, left) + m * expectation(nodes, known, x, right)) / (n + m)


def enumerated(trees, weights, x):
    value = lambda known: sum(w * expectation(t, known, x) for t, w in zip(trees, weights))
    n, out = len(x), []
    for f in range(n):
        rest = [g for g in range(n) if g != f]
        out.append(sum(
            factorial(len(s)) * factorial(n - 1 - len(s)) / factorial(n) * (value({*s, f}) - value(set(s)))
            for k in range(n) for s in itertools.combinations(rest, k)))
    return out, value(set())


@pytest.mark.parametrize("kind,params", [("forest", {"numTrees": 4, "maxDepth": 4}), ("boosted", {"maxIter": 5, "maxDepth": 3}), ("tree", {"maxDepth": 5})])
def test_equals_enumeration_and_adds_up(spark, table, kind, params, tmp_path):
    if kind == "tree":
        shaped = features.assemble(table.withColumn("label", F.col("y")), COLUMNS, keep=["label"])
        model = DecisionTreeRegressor(**params).fit(shaped)
    else:
        model = modelling.fit_regressor(table, COLUMNS, "y", kind, **params)
    some = table.filter("id < 12").withColumn("b", F.when(F.col("id") != 3, F.col("b")))  # a missing feature counts as 0
    found = tree_attribution.tree_attributions(model, some, ["id"], COLUMNS).collect()
    assert len(found) == 12 * 4 and max(abs(r["residual"]) for r in found) < 1e-9
    model.write().save(f"{tmp_path}/m")
    saved = spark.read.parquet(f"{tmp_path}/m/data")
    saved = saved.select(F.lit(0).alias("treeID"), *saved.columns) if kind == "tree" else saved.select("treeID", "nodeData.*")
    trees = {}
    for r in saved.collect():
        trees.setdefault(r["treeID"], {})[r["id"]] = r.asDict(recursive=True)
    trees = [t for _, t in sorted(trees.items())]
    weights = {"forest": [1 / len(trees)] * len(trees), "tree": [1.0]}.get(kind) or list(model.treeWeights)
    rows = {(r["id"], r["feature"]): r for r in found}
    for r in some.collect():
        want, base = enumerated(trees, weights, [r[c] or 0.0 for c in COLUMNS])
        assert [rows[r["id"], c]["phi"] for c in COLUMNS] == pytest.approx(want, abs=1e-9)
        assert rows[r["id"], "a"]["base"] == pytest.approx(base, abs=1e-9)


def test_no_rows_and_one_leaf(spark, table):
    flat = modelling.fit_regressor(table.withColumn("y", F.lit(2.0)), COLUMNS, "y", "forest", numTrees=2, maxDepth=3)
    found = tree_attribution.tree_attributions(flat, table.limit(3), ["id"], COLUMNS).collect()
    assert {(r["phi"], r["base"], r["prediction"]) for r in found} == {(0.0, 2.0, 2.0)}
    assert tree_attribution.tree_attributions(flat, table.limit(0), ["id"], COLUMNS).collect() == []


def test_leaf_shares_are_worked_out_per_pattern(spark, table, monkeypatch, tmp_path):
    """Many rows of few patterns of passed features: the work of a leaf does not grow with the rows, the values stay."""
    model = modelling.fit_regressor(table, COLUMNS, "y", "forest", numTrees=3, maxDepth=4)
    trees = tree_attribution.read_trees(model, spark)
    x = np.random.default_rng(3).normal(size=(500, 4))
    widths, shares = [], tree_attribution._leaf_shares
    monkeypatch.setattr(tree_attribution, "_leaf_shares", lambda leaf, z, v, one: widths.append(one.shape[1]) or shares(leaf, z, v, one))
    phi, base = tree_attribution.explain(trees, x)
    assert max(widths) <= 2**4
    monkeypatch.setattr(tree_attribution, "PATTERNS", 0)
    plain, plain_base = tree_attribution.explain(trees, x)
    assert np.array_equal(phi, plain) and base == plain_base and max(widths) == 500
