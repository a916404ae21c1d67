"""Forests that grow together on cells of equal bins, against plain forms and Spark's own forest."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelytics import fixed_values as fv
from parcelytics.operators import features as ft
from parcelytics.operators import forest
from parcelytics.operators import modelling as ml


def plain_limits(values, weights):
    values, at = np.unique(values, return_inverse=True)
    weights = np.bincount(at, weights)
    if len(values) <= forest.BINS:
        return [(a + b) / 2 for a, b in zip(values, values[1:])]
    stride, out, ends = weights.sum() / forest.BINS, [], np.cumsum(weights)
    for before, after, a, b in zip(ends, ends[1:], values, values[1:]):
        share = stride * (len(out) + 1)
        if abs(before - share) < abs(after - share):
            out.append((a + b) / 2)
    return out


@pytest.mark.parametrize("seed", range(20))
def test_limits_are_those_of_the_plain_walk(seed):
    rng = np.random.default_rng(seed)
    values, weights = rng.integers(0, rng.integers(2, 120), 150).astype(float), rng.integers(1, 50, 150)
    assert np.allclose(forest.limits_of(values, weights), plain_limits(values, weights))


def test_best_split_leaves_the_least_squares():
    rng = np.random.default_rng(1)
    codes, y, w = rng.integers(0, 4, (200, 2)), rng.random(200), rng.poisson(1, 200)
    y += codes[:, 1] > 1
    hist = np.stack([np.stack([np.bincount(codes[:, j], w, forest.BINS), np.bincount(codes[:, j], w * y, forest.BINS)], 1) for j in range(2)])
    spread = lambda rows: (w[rows] * (y[rows] - np.average(y[rows], weights=w[rows])) ** 2).sum()
    left = {(j, c): spread(codes[:, j] <= c) + spread(codes[:, j] > c) for j in range(2) for c in range(3)}
    assert forest.best_split(hist)[:2] == min(left, key=left.get) == (1, 1)
    assert forest.best_split(np.zeros((2, forest.BINS, 2)))[0] == -1


@pytest.fixture(scope="module")
def listings(spark):
    k = F.col("id")
    hashed = lambda n, m: F.pmod(F.xxhash64(k, F.lit(n)), F.lit(m))
    df = spark.range(12000).select(
        hashed(1, 5).cast("int").alias("fold"), F.when(hashed(2, 40) > 0, F.concat(F.lit("g"), hashed(2, 40))).alias("place"),
        hashed(3, 60).cast("double").alias("a"), F.when(hashed(4, 9) > 0, hashed(4, 9)).alias("b"), (hashed(5, 10**6) / 1e6).alias("c"))
    noise = F.pmod(F.xxhash64("a", "b", "c"), F.lit(1000)) / 1000
    return ml.freeze(df.withColumn("y", F.log(F.col("a") + 1) + F.coalesce("b", F.lit(0)) / 4 + F.col("c") + F.coalesce(F.length("place"), F.lit(0)) + noise))


def test_large_inputs_are_cross_validated_together(spark, listings, monkeypatch):
    of = lambda rows: {r["fold"]: r for r in rows.collect()}
    for group in ("place", None):
        small = of(ml.cross_validate(listings, ["a", "b", "c"], "y", "fold", group, "forest", numTrees=6, maxDepth=4))
        with monkeypatch.context() as patch:
            patch.setattr(ml, "FIT_BYTES", 0)
            patch.setattr(ml, "fit_regressor", lambda *_, **__: pytest.fail("one fit after the other"))
            patch.setattr(forest, "FEW", 100)  # c has more
            large = ml.cross_validate(listings, ["a", "b", "c"], "y", "fold", group, "forest", numTrees=6, maxDepth=4)
            whole = of(large)
            patch.setattr(forest, "SUMS", 1)  # a fold at a time
            single = of(ml.cross_validate(listings, ["a", "b", "c"], "y", "fold", group, "forest", numTrees=6, maxDepth=4))
        assert large.columns == ["n", "r2", "rmse_log", "mae_log", "mae", "mape", "median_ape", "fold"]
        assert {f: r["n"] for f, r in whole.items()} == {f: r["n"] for f, r in small.items()} and len(whole) == 6
        for f, r in whole.items():
            assert abs(r["r2"] - small[f]["r2"]) < 0.03 and abs(r["median_ape"] / small[f]["median_ape"] - 1) < 0.1
            assert np.allclose([r[c] for c in large.columns[:-1]], [single[f][c] for c in large.columns[:-1]])


def test_large_inputs_are_searched_together(spark, listings, monkeypatch):
    space, of = {"numTrees": [2, 8], "maxDepth": [1, 5]}, lambda rows: {r["params"]: r["mean_r2"] for r in rows.collect()}
    args = (listings, ["a", "b", "c"], "y", "fold", "forest", space, 4, 5)
    small = of(ml.random_search_cv(*args))
    monkeypatch.setattr(ml, "FIT_BYTES", 0)
    monkeypatch.setattr(ml, "CrossValidator", lambda *_, **__: pytest.fail("one fit after the other"))
    large = of(ml.random_search_cv(*args))
    assert large.keys() == small.keys() and all(abs(large[p] - small[p]) < 0.04 for p in small)
    assert large["{'maxDepth': 5, 'numTrees': 8}"] > large["{'maxDepth': 1, 'numTrees': 8}"] + 0.1


def test_r2_of_cells_is_that_of_the_rows(spark, listings):
    forests, rows, r2 = forest.grown(listings, ["a", "b", "c"], "y", "fold", None, None, 3, 4, settings=[(3, 4)])
    scored = {r["fold"]: r["r2"] for r in ml.metrics(forest.scores(forests, rows), "label", "prediction", ["held"]).withColumnRenamed("held", "fold").collect()}
    assert np.allclose(r2[0], [scored[str(f)] for f in range(5)], atol=1e-9)


def test_encoding_equals_that_of_the_tables(spark, listings):
    forests, rows, _ = forest.grown(listings, ["a"], "y", "fold", "place", [2], 1, 1)
    train, test = listings.filter("fold <> 2"), listings.filter("fold = 2")
    tables = ft.target_encode_oof(train, "place", "y", "fold").select("fold", "place", "target_enc").distinct().unionAll(
        ft.apply_target_encoding(test, ft.target_encoding(train, "place", "y"), "place").select("fold", "place", "target_enc").distinct())
    places = {r["place"]: None for r in listings.select("place").distinct().collect()}
    names = sorted(places, key=lambda p: (p is not None, p or ""))  # the order of the numbers: missing first
    found = {(f, p): v for f in range(5) for p, v in zip(names, forests.encoding.of(2, np.full(len(names), f), np.arange(len(names))))}
    expected = {(r["fold"], r["place"]): r["target_enc"] for r in tables.collect()}
    assert expected.keys() <= found.keys() and None in places and all(abs(found[k] - v) < 1e-9 for k, v in expected.items())
    assert fv.ENCODING_SMOOTHING > 0


def test_rows_without_label_or_with_nan_are_refused(spark, listings):
    for broken in (listings.withColumn("y", F.when(F.col("a") > 0, F.col("y"))), listings.withColumn("a", F.when(F.col("a") > 0, F.col("a")).otherwise(float("nan")))):
        with pytest.raises(ValueError):
            forest.grown(broken, ["a"], "y", "fold", None, None, 1, 1)


def test_inputs_with_too_many_cells_go_the_plain_way(spark, listings, monkeypatch):
    monkeypatch.setattr(ml, "FIT_BYTES", 0)
    monkeypatch.setattr(forest, "CELLS", 20)
    assert forest.grown(listings, ["a", "b"], "y", "fold", None, None, 1, 1) is None
    rows = ml.cross_validate(listings, ["a", "b"], "y", "fold", None, "forest", numTrees=2, maxDepth=2).collect()
    assert {r["fold"] for r in rows} == {"0", "1", "2", "3", "4", "mean"}
