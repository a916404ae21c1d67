"""The plans for large inputs give the same results as the plain ones, in any partitioning."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelytics.operators import rules, usage
from parcelytics.plans import scale, spatial
from parcelytics.plans.spatial import count_within, nearest
from parcelytics.sources import readers


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds a third of the rows, and one value a third of those."""
    rng = random.Random(5)
    rows = []
    for i in range(6000):
        group = None if i % 50 == 0 else "hot" if i % 3 == 0 else f"g{rng.randrange(40)}"
        value = 7.0 if group == "hot" and i % 9 == 0 else None if i % 97 == 0 else round(rng.expovariate(0.01), 2)
        rows.append((i, group, value))
    return spark.createDataFrame(rows, "id long, g string, v double").repartition(7)


@pytest.fixture(scope="module")
def stored(skewed, spark, tmp_path_factory):
    """The skewed rows, a group without values and one with NaN, read back from Parquet so that their size is known."""
    path = str(tmp_path_factory.mktemp("stored") / "rows")
    extra = [(9000, "void", None), (9001, "void", None), (9002, "nan", float("nan")), (9003, "nan", 1.0), (9004, "nan", 2.0), (9005, "only nan", float("nan"))]
    skewed.unionByName(spark.createDataFrame(extra, skewed.schema)).write.parquet(path)
    frame = spark.read.parquet(path)
    assert scale.is_small(frame) and not scale.is_small(frame, 0)
    return frame


@pytest.mark.parametrize("accuracy,in_one_task", [(10_000, 5_000_000), (50, 5_000_000), (50, 0)])
@pytest.mark.parametrize("keys", [["g"], []])
def test_quantiles_agree_on_missing_values(stored, keys, accuracy, in_one_task, monkeypatch):
    monkeypatch.setattr(scale, "QUANTILE_ACCURACY", accuracy)
    monkeypatch.setattr(scale, "ONE_TASK_VALUES", in_one_task)
    probs = {"lo": 0.0, "q1": 0.25, "med": 0.5, "hi": 1.0}
    small = {r["g"] if keys else 0: r for r in scale.exact_quantiles(stored, keys, "v", probs).collect()}
    large = {r["g"] if keys else 0: r for r in scale.exact_quantiles(stored, keys, "v", probs, 0).collect()}
    assert small.keys() == large.keys()
    for k, row in small.items():
        for p in probs:
            a, b = row[p], large[k][p]
            assert a is None and b is None or math.isclose(a, b, rel_tol=1e-12), (k, p)
    if keys:
        assert small["void"]["med"] is None and small["only nan"]["med"] is None and small["nan"]["hi"] == 2.0


@pytest.mark.parametrize("most", [30, 100_000])
def test_groups_a_task_can_hold_are_one_aggregate(stored, most, monkeypatch):
    probs, also = {"q1": 0.25, "med": 0.5}, [F.count("*").alias("n")]
    plain = {r["g"]: tuple(r) for r in scale.exact_quantiles(stored, ["g"], "v", probs, also=also).collect()}
    columns = {r["g"]: tuple(r) for r in scale.quantile_of_columns(stored, ["g"], ["v", "id"], 0.5, also).collect()}
    monkeypatch.setattr(scale, "ONE_TASK_BYTES", 0)
    monkeypatch.setattr(scale, "GROUP_VALUES", most)
    large = scale.exact_quantiles(stored, ["g"], "v", probs, also=also)
    wide = scale.quantile_of_columns(stored, ["g"], ["v", "id"], 0.5, also)
    for frame, expected in ((large, plain), (wide, columns)):
        got = {r["g"]: tuple(r[c] for c in (*["g"], *[c for c in frame.columns if c != "g"])) for r in frame.select(*(["g", "n", "q1", "med"] if frame is large else ["g", "n", "v", "id"])).collect()}
        assert got.keys() == expected.keys()
        for g, row in got.items():
            want = dict(zip(["g", "n", "q1", "med"] if frame is large else ["g", "n", "v", "id"], expected[g]))
            assert row[1] == want["n"]
            assert all(a is None and b is None or math.isclose(a, b, rel_tol=1e-12) for a, b in zip(row[2:], expected[g][2:])), g
    if most > 6000:  # no group is larger: nothing is stacked, joined or counted by value
        for frame in (large, wide):
            assert "Join" not in frame._jdf.queryExecution().optimizedPlan().toString()


def as_set(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize("accuracy", [10_000, 50])
@pytest.mark.parametrize("keys", [["g"], []])
def test_exact_quantiles_of_both_plans(skewed, keys, accuracy, monkeypatch):
    monkeypatch.setattr(scale, "QUANTILE_ACCURACY", accuracy)
    probs = {"p0": 0.0, "p005": 0.005, "q1": 0.25, "med": 0.5, "p99": 0.99, "p1": 1.0}
    large = {r["g"] if keys else 0: r for r in scale.exact_quantiles(skewed, keys, "v", probs, 0).collect()}
    frame = skewed.toPandas().dropna(subset=["v"])
    groups = frame.groupby("g", dropna=False) if keys else [(0, frame)]
    seen = 0
    for name, part in groups:
        name = None if name is not None and name != name else name
        for label, p in probs.items():
            assert math.isclose(large[name][label], np.quantile(part["v"], p), rel_tol=1e-12, abs_tol=1e-9), (name, label)
        seen += 1
    assert seen == len(large)


@pytest.mark.parametrize("keys", [["g"], []])
def test_positions_of_both_plans(stored, keys):
    skewed = stored
    order = [F.col("v").desc_nulls_last(), F.col("id")]
    running = {"total": F.coalesce(F.nanvl("v", F.lit(0.0)), F.lit(0.0)).cast("decimal(20,2)")}
    small = scale.with_positions(skewed, keys, order, "rn", running)
    large = scale.with_positions(skewed, keys, order, "rn", running, 0)
    columns = ["id", "rn", "total"]
    assert as_set(small.select(*columns)) == as_set(large.select(*columns))
    plain = scale.with_positions(skewed, keys, order, "rn", one_task_bytes=0)
    assert as_set(plain.select("id", "rn")) == as_set(small.select("id", "rn"))


def test_ranks_of_both_plans(stored):
    skewed = stored
    columns = ["id", "rank_min", "rank_avg"]
    small = scale.with_value_rank(skewed, ["g"], "v", True).select(*columns)
    large = scale.with_value_rank(skewed, ["g"], "v", True, one_task_bytes=0).select(*columns)
    assert as_set(small) == as_set(large)


@pytest.mark.parametrize("parts", [1, 17])
def test_results_do_not_depend_on_partitioning(skewed, parts):
    columns = ["id", "g", "v"]
    base = as_set(rules.trim_per_group(rules.quantile_band(skewed, "v"), "v", "g").select(*columns))
    other = skewed.repartition(parts)
    assert as_set(rules.trim_per_group(rules.quantile_band(other, "v"), "v", "g").select(*columns)) == base


def test_fill_down_of_both_plans(stored, monkeypatch):
    skewed = stored
    order = [F.col("id")]
    small = as_set(readers.fill_down(skewed, ["g"], order, ["v"]))
    monkeypatch.setattr(scale, "ONE_TASK_BYTES", 0)
    assert as_set(readers.fill_down(skewed, ["g"], order, ["v"]).select("id", "g", "v")) == small


def test_rolling_quota_of_both_plans(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    args = ("user_id", "event_id", "ts", 7, 10)
    columns = ["event_id", "used", "remaining", "blocked"]
    assert as_set(usage.rolling_quota(events, *args).select(*columns)) == as_set(usage.rolling_quota(events, *args, one_task_bytes=0).select(*columns))


def test_rolling_quota_counts_repeated_and_missing_ids(spark, tmp_path):
    rows = [("u", 1, "2024-01-01 00:00:00"), ("u", 1, "2024-01-02 00:00:00"), ("u", None, "2024-01-03 00:00:00"), ("u", None, None), ("u", 5, None),
            (None, 6, "2024-01-01 00:00:00"), (None, 6, "2024-01-01 00:00:00"), ("u", 7, "2024-01-20 00:00:00")]
    spark.createDataFrame(rows, "who string, event long, at string").withColumn("at", F.col("at").cast("timestamp")).write.parquet(f"{tmp_path}/rows")
    events = spark.read.parquet(f"{tmp_path}/rows")
    assert scale.is_small(events)
    args = (events, "who", "event", "at", 7, 2)
    columns = ["who", "event", "at", "used", "remaining", "blocked"]
    small, large = usage.rolling_quota(*args), usage.rolling_quota(*args, one_task_bytes=0)
    assert as_set(small.select(*columns)) == as_set(large.select(*columns))
    assert sorted(r["used"] for r in large.collect()) == [1, 1, 2, 2, 2, 2, 2, 3]


def test_pairs_over_the_date_line_and_the_poles(spark):
    rng = random.Random(9)
    spots = [(rng.uniform(-5, 5), rng.choice((1, -1)) * (180 - rng.uniform(0, 0.05))) for _ in range(60)] + [(rng.choice((1, -1)) * (90 - rng.uniform(0, 0.05)), rng.uniform(-180, 180)) for _ in range(60)]
    spots += [(0.0, 179.999), (0.0, -179.999), (90.0, 0.0), (-90.0, 30.0)]
    p, t = spark.createDataFrame(spots, "lat double, lon double"), spark.createDataFrame(spots, "t_lat double, t_lon double")
    counts = {(r["lat"], r["lon"]): r["n"] for r in count_within(p, t, 4.0).collect()}
    for point in spots:
        assert counts.get(point, 0) == sum(hav(point, x) <= 4.0 for x in spots), point


def test_keep_first_is_null_safe_and_total(skewed):
    first = scale.keep_first(skewed, ["g"], [F.col("v").isNull(), F.col("v"), F.col("id")]).collect()
    frame = skewed.toPandas().sort_values(["v", "id"], na_position="last").groupby("g", dropna=False).head(1)
    assert {r["id"] for r in first} == set(frame["id"])


def hav(a, b):
    (la, lo), (lb, lob) = a, b
    p, q = math.radians(la), math.radians(lb)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(lob - lo) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(h))


@pytest.mark.parametrize("crowded", [40, 512])
def test_spatial_joins_against_brute_force(spark, monkeypatch, crowded):
    monkeypatch.setattr(spatial, "CROWDED", crowded)  # with few spots a cell, searches descend the pyramid
    rng = random.Random(3)
    cluster = [(52 + rng.gauss(0, 0.001), 13 + rng.gauss(0, 0.001)) for _ in range(150)]
    targets = cluster + [(rng.uniform(-60, 60), rng.uniform(-120, 120)) for _ in range(40)] + cluster[:30]
    points = [(52 + rng.gauss(0, 0.01), 13 + rng.gauss(0, 0.01)) for _ in range(60)] + [(rng.uniform(-60, 60), rng.uniform(-120, 120)) for _ in range(20)]
    p = spark.createDataFrame(points, "lat double, lon double")
    t = spark.createDataFrame(targets, "t_lat double, t_lon double")
    near = {(r["lat"], r["lon"]): r["km"] for r in nearest(p, t).collect()}
    counts = {(r["lat"], r["lon"]): r["n"] for r in count_within(p, t, 0.9).collect()}
    for point in points:
        distances = [hav(point, x) for x in targets]
        assert math.isclose(near[point], min(distances), rel_tol=1e-9)
        assert counts.get(point, 0) == sum(d <= 0.9 for d in distances)


@pytest.mark.parametrize("crowded", [12, 512])
def test_nearest_at_the_poles_and_over_the_date_line(spark, monkeypatch, crowded):
    monkeypatch.setattr(spatial, "CROWDED", crowded)
    rng = random.Random(12)
    pole = lambda: (rng.choice((1, -1)) * (90 - rng.uniform(0, 2)), rng.uniform(-180, 180))
    line = lambda: (rng.uniform(-40, 40), rng.choice((1, -1)) * (180 - rng.uniform(0, 1)))
    targets = [(*f(), k) for k in ("a", "b") for f in (pole, line) for _ in range(25)] + [(90.0, 0.0, "a"), (-90.0, 77.0, "b")]
    points = [f() for f in (pole, line) for _ in range(15)] + [(90.0, 10.0), (-90.0, 0.0), (0.0, 180.0), (0.0, -180.0)]
    p, t = spark.createDataFrame(points, "lat double, lon double"), spark.createDataFrame(targets, "t_lat double, t_lon double, k string")
    found = {(r["lat"], r["lon"], r["k"]): r["km"] for r in nearest(p, t, "k", ["a", "b"]).collect()}
    for point in points:
        for k in ("a", "b"):
            assert math.isclose(found[(*point, k)], min(hav(point, x[:2]) for x in targets if x[2] == k), rel_tol=1e-9, abs_tol=1e-6)


def test_a_hundred_thousand_targets_in_one_cell(spark):
    """Counts and nearest search over a cluster: cells inside the disc add their counts, few targets are compared."""
    side, gap = 320, 1e-5
    targets = spark.range(side * side).select((50 + (F.col("id") % side) * gap).alias("t_lat"), (10 + F.floor(F.col("id") / side) * gap).alias("t_lon"))
    points = [(50 + side * gap / 2, 10 + side * gap / 2), (50.0, 10.0), (50.02, 10.0), (49.0, 9.0)]
    p = spark.createDataFrame(points, "lat double, lon double")
    grid = targets.toPandas()
    want = {}
    for lat, lon in points:
        a, b, c, d = (np.radians(v) for v in (lat, lon, grid["t_lat"].to_numpy(), grid["t_lon"].to_numpy()))
        h = np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2
        want[lat, lon] = 2 * 6371.0088 * np.arcsin(np.sqrt(h))
    counts = {(r["lat"], r["lon"]): r["n"] for r in count_within(p, targets, 0.15).collect()}
    assert counts == {point: (km <= 0.15).sum() for point, km in want.items() if (km <= 0.15).any()}
    assert {(r["lat"], r["lon"]): pytest.approx(r["km"], rel=1e-9, abs=1e-9) for r in nearest(p, targets).collect()} == {k: v.min() for k, v in want.items()}
