"""Several columns at once give what each column alone gives."""

import math
import random

import pytest

from parcelytics.operators import features
from parcelytics.plans import scale


@pytest.mark.parametrize("keys", [["g"], []])
def test_quantile_of_columns_in_both_plans(spark, tmp_path, keys):
    rng = random.Random(8)
    rows = [(None if i % 40 == 0 else f"g{rng.randrange(5)}", rng.random(), None if i % 7 == 0 else float(rng.randrange(9)), None) for i in range(900)]
    rows += [("void", None, float("nan"), None)]
    spark.createDataFrame(rows, "g string, a double, b double, c double").write.parquet(f"{tmp_path}/rows")
    frame = spark.read.parquet(f"{tmp_path}/rows")
    small = {r["g"] if keys else 0: r for r in scale.quantile_of_columns(frame, keys, ["a", "b", "c"], 0.4).collect()}
    large = {r["g"] if keys else 0: r for r in scale.quantile_of_columns(frame, keys, ["a", "b", "c"], 0.4, one_task_bytes=0).collect()}
    assert small.keys() == large.keys()
    for k, row in small.items():
        for c in ("a", "b", "c"):
            x, y = row[c], large[k][c]
            assert x is None and y is None or math.isclose(x, y, rel_tol=1e-12)


def test_screened_features_count_distinct_values(spark):
    rows = [(float(i), float(i % 3), None if i % 2 else 1.0, float(i * i)) for i in range(50)]
    got = {r["feature"]: (r["nulls"], r["distinct"]) for r in features.screen_features(spark.createDataFrame(rows, "a double, b double, c double, size double"), ["a", "b", "c"], "size").collect()}
    assert got == {"a": (0, 50), "b": (0, 3), "c": (25, 1)}
