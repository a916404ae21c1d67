"""Second-order boosting against a plain single-machine form of the same rules, and against Spark's boosted trees on held-out rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelytics.operators import boosting, modelling
from parcelytics.session import freeze

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    x = np.stack([rng.normal(size=1500).round(2), rng.integers(0, 6, 1500), rng.random(1500)], 1)
    y = np.sin(2 * x[:, 0]) * x[:, 1] + (x[:, 2] > 0.6) * 2 + rng.normal(size=1500) / 5
    return x, y


@pytest.fixture(scope="module")
def table(spark, rows):
    data = [(i, *map(float, r), float(y)) for i, (r, y) in enumerate(zip(*rows))]
    return spark.createDataFrame(data, "id long, a double, b double, c double, y double").repartition(7)


def plain_boost(x, y, rounds, depth, rate, l2, least, gamma):
    """All values as limits (fewer than the bins), one node after the other."""
    out = np.full(len(y), y.mean())
    for _ in range(rounds):
        node = {0: np.arange(len(y))}
        value = np.zeros(len(y))
        for level in range(depth + 1):
            following = {}
            for n, members in node.items():
                g = out[members] - y[members]
                value[members] = -rate * g.sum() / (len(members) + l2)
                best = None
                for f in range(x.shape[1]) if level < depth else []:
                    for limit in np.unique(x[:, f])[:-1]:
                        left = x[members, f] <= limit
                        if min(left.sum(), (~left).sum()) < least:
                            continue
                        gain = (g[left].sum() ** 2 / (left.sum() + l2) + g[~left].sum() ** 2 / ((~left).sum() + l2) - g.sum() ** 2 / (len(g) + l2)) / 2 - gamma
                        if best is None or gain > best[0] + 1e-9:
                            best = (gain, left)
                if best and best[0] > 1e-9:
                    following[2 * n + 1], following[2 * n + 2] = members[best[1]], members[~best[1]]
            node = following
        out = out + value
    return out


@pytest.mark.parametrize("settings", [dict(rounds=3, depth=3, rate=0.3, l2=2.0, least=5.0, gamma=0.1), dict(rounds=12, depth=1, rate=0.5, l2=0.0, least=1.0, gamma=0.0)])
def test_equals_the_plain_form(spark, rows, table, settings):
    x, y = rows[0][:150].copy(), rows[1][:150]
    x[:, 2] = x[:, 2].round(1)
    data = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "id long, a double, b double, c double, y double").repartition(5)
    model = modelling.fit_regressor(data, COLUMNS, "y", "second_order", **settings)
    found = {r["id"]: r["prediction"] for r in modelling.predict(model, data, COLUMNS).collect()}
    assert [found[i] for i in range(150)] == pytest.approx(plain_boost(x, y, **settings).tolist(), abs=1e-9)


def test_beats_the_first_order_trees(table):
    train, test = table.filter("id % 4 <> 0"), table.filter("id % 4 = 0")
    error = {}
    for kind, settings in (("second_order", dict(rounds=20, depth=4, rate=0.3, l2=2.0)), ("boosted", dict(maxIter=20, maxDepth=4, stepSize=0.3))):
        scored = modelling.predict(modelling.fit_regressor(train, COLUMNS, "y", kind, **settings), test, COLUMNS)
        error[kind] = scored.agg(F.avg((F.col("y") - F.col("prediction")) ** 2)).first()[0]
    assert error["second_order"] < error["boosted"]


def test_runs_agree_and_samples_are_seeded(table, monkeypatch):
    settings = dict(rounds=4, depth=3, column_share=0.6, row_share=0.7)
    first, again = (modelling.fit_regressor(table, COLUMNS, "y", "second_order", **settings) for _ in range(2))
    other = modelling.fit_regressor(table, COLUMNS, "y", "second_order", seed=5, **settings)
    same = lambda a, b: all(np.array_equal(s.limit, t.limit) and np.array_equal(s.value, t.value) for s, t in zip(a.trees, b.trees))
    assert same(first, again) and not same(first, other)
    assert max(len(set(t.feature[t.feature >= 0])) for t in first.trees) <= 2
    monkeypatch.setattr(boosting, "TOGETHER", 2)  # histograms are added in steps
    stepped = modelling.fit_regressor(table, COLUMNS, "y", "second_order", **settings)
    assert all(np.allclose(s.value, t.value) for s, t in zip(first.trees, stepped.trees))


def test_no_rows_and_one_value(table):
    empty = modelling.fit_regressor(table.limit(0), COLUMNS, "y", "second_order", rounds=2)
    assert [r["prediction"] for r in modelling.predict(empty, table.limit(1), COLUMNS).collect()] == [0.0]
    flat = modelling.fit_regressor(table.limit(20).withColumn("y", F.lit(3.5)), COLUMNS, "y", "second_order", rounds=2, depth=2)
    assert {r["prediction"] for r in modelling.predict(flat, table.limit(5), COLUMNS).collect()} == {3.5}


@pytest.mark.parametrize("limit", [0, 1 << 40])
def test_fit_and_score_works_its_rows_out_once(spark, limit, monkeypatch, tmp_path):
    """The rows and the scores of a large input are written once, with the same metrics as fits and scores of their own."""
    spark.range(300, numPartitions=1).selectExpr("id", "id % 7 AS a", "1.0 * id AS y").write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    data = modelling.random_split(rows, ["id"], 0.3, 1)
    monkeypatch.setattr(modelling, "FIT_BYTES", limit)
    written = []
    monkeypatch.setattr(modelling, "freeze", lambda df: written.append(df.columns) or freeze(df))
    out = modelling.fit_and_score(data, "is_test", ["a"], "y", {"f": ("forest", {"numTrees": 2, "maxDepth": 2}), "l": ("linear", {})})
    found = {r["model"]: r["r2"] for r in out.collect()}
    assert written == ([["a", "y", "is_test"], ["y", "prediction"], ["y", "prediction"]] if limit == 0 else [])
    for name, kind, params in (("f", "forest", {"numTrees": 2, "maxDepth": 2}), ("l", "linear", {})):
        model = modelling.fit_regressor(data.filter("NOT is_test"), ["a"], "y", kind, **params)
        want = modelling.metrics(modelling.predict(model, data.filter("is_test"), ["a"]), "y", "prediction").first()["r2"]
        assert found[name] == pytest.approx(want, abs=1e-9)
