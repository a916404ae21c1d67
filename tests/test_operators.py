"""Closed-form and brute-force cases for operators that SQL cannot express, and the invariants of the others."""

import difflib
import math
import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelytics.functions import geo, text
from parcelytics.operators import expect, features, matching, modelling, rules, serving, spatial, usage


def one(spark, **columns):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()])


def test_square_of_100_metres(spark):
    side_lat = 100 / 111194.93
    side_lon = side_lat / 0.99284
    ring = [(79.9, 6.86), (79.9 + side_lon, 6.86), (79.9 + side_lon, 6.86 + side_lat), (79.9, 6.86 + side_lat)]
    df = spark.createDataFrame([([{"lon": x, "lat": y} for x, y in ring],)], "ring array<struct<lon:double,lat:double>>")
    area = df.select(geo.spherical_ring_area(F.col("ring")).alias("a")).first()["a"]
    assert area == pytest.approx(10_000, rel=0.01)
    assert df.select(geo.m2_to_perches(geo.spherical_ring_area(F.col("ring")))).first()[0] == pytest.approx(395, abs=4)


def test_haversine_of_a_known_pair_and_of_null(spark):
    got = one(spark, x=1).select(
        geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0), 1.0).alias("quarter"),
        geo.haversine(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("none")).first()
    assert got["quarter"] == pytest.approx(1.5707963267948966) and got["none"] is None


def test_single_row_group_survives_the_trim(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 1.1), ("b", 0.9), ("b", 50.0)], "g string, v double")
    assert {tuple(r) for r in rules.trim_per_group(df, "v", "g", 1.0).collect()} == {("a", 1.0), ("b", 1.0), ("b", 1.1), ("b", 0.9)}


def test_dedup_matches_nulls_counts_copies_and_loses_nothing(spark):
    rows = [("t", None, "2024-01-02", 1), ("t", None, "2024-01-01", 2), ("t", None, None, 3), ("u", "x", None, 4), ("u", "x", None, 4), ("v", "x", None, 5)]
    df = spark.createDataFrame(rows, "title string, address string, posted string, id int")
    keep, gone = rules.dedup_keep_earliest(df, ["title", "address"], "posted", [F.col("id")])
    assert {r["id"] for r in keep.collect()} == {2, 4, 5}
    assert keep.count() + gone.agg(F.sum("copies")).first()[0] == len(rows)


def test_rules_split_is_complete_and_ordered(spark):
    df = spark.range(100).withColumn("v", F.when(F.col("id") % 7 != 0, F.col("id")))
    flagged = rules.apply_rules(df, [("even", F.col("v") % 2 == 0), ("big", F.col("v") > 50)])
    assert rules.kept(flagged).count() + rules.dropped(flagged).count() == 100
    assert flagged.filter("drop_rule = 'big'").filter("v % 2 = 0").isEmpty()
    counts = rules.rule_counts(flagged, ["even", "big", "never"]).orderBy("step").collect()
    assert counts[-1]["remaining"] == rules.kept(flagged).count() and counts[-1]["dropped"] == 0


def test_name_reduction_and_sound_keys(spark):
    names = ["Kirulapone North", "Wanathamulla  A", "Havelock Town", "Maha Buthgamuwa", "Galle Face New Town", "North", "Udumulla-East 'B'"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", text.reduce_name(F.col("n")).alias("r"))
    got = {r["n"]: (r["r"]["base"], list(r["r"]["qualifiers"])) for r in df.collect()}
    assert got["Kirulapone North"] == ("Kirulapone", ["North"]) and got["Havelock Town"] == ("Havelock Town", [])
    assert got["Udumulla-East 'B'"] == ("Udumulla", ["B", "East"]) and got["North"] == ("North", [])
    keys = spark.createDataFrame([("Kotahena",), ("Kottahena",), ("Thalawathugoda",), ("Talawatugoda",)], "t string").select(text.sound_key(F.col("t")).alias("k"))
    values = [r["k"] for r in keys.collect()]
    assert values[0] == values[1] and values[2] == values[3]


@pytest.mark.parametrize("cutoff", [0.85, 0.90])
def test_fuzzy_join_loses_no_match_of_either_ratio(spark, cutoff):
    rng = random.Random(11)
    pool = sorted({"".join(rng.choice("abcde") for _ in range(rng.randrange(4, 14))) for _ in range(150)})
    queries = set()
    for name in pool:
        s = list(name)
        for _ in range(rng.randrange(0, 3)):
            at = rng.randrange(len(s))
            kind = rng.randrange(3)
            if kind == 0 and len(s) > 2:
                del s[at]
            elif kind == 1:
                s.insert(at, rng.choice("abcde"))
            else:
                s[at] = rng.choice("abcde")
        queries.add("".join(s))
    q = spark.createDataFrame([(x,) for x in sorted(queries)], "q string")
    p = spark.createDataFrame([(x,) for x in pool], "n string")
    got = {r["q"]: r["n"] for r in matching.fuzzy_match(q, "q", p, "n", cutoff, "matching").collect()}
    for x in queries:
        close = difflib.get_close_matches(x, pool, n=1, cutoff=cutoff)
        assert got.get(x) == (close[0] if close else None), x


def test_group_folds_follow_the_greedy_rule(spark):
    rng = random.Random(2)
    sizes = {f"g{i:03d}": rng.choice([1, 1, 1, 2, 3, 5, 8, 40]) for i in range(120)} | {"giant": 500}
    rows = [(g,) for g, n in sizes.items() for _ in range(n)]
    df = spark.createDataFrame(rows, "g string")
    got = {r["g"]: r["fold"] for r in modelling.group_folds(df, "g", 5).collect()}
    loads, want = [0] * 5, {}
    for g in sorted(sizes, key=lambda g: (-sizes[g], g)):
        fold = loads.index(min(loads))
        want[g] = fold
        loads[fold] += sizes[g]
    assert got == want
    shuffled = modelling.shuffled_group_folds(df, "g", 5, 3).groupBy("fold").agg(F.sum("n").alias("n")).collect()
    assert sorted(r["n"] for r in shuffled) == sorted(loads)


def test_out_of_fold_encoding_never_sees_its_own_fold(spark):
    rows = [("a", 0, 1.0), ("a", 1, 3.0), ("a", 1, 5.0), ("b", 0, 10.0)]
    df = spark.createDataFrame(rows, "g string, fold int, y double")
    got = {(r["g"], r["fold"]): r["target_enc"] for r in features.target_encode_oof(df, "g", "y", "fold", 10.0).collect()}
    mean = 19 / 4
    assert got[("a", 0)] == pytest.approx((8 + 10 * mean) / 12) and got[("a", 1)] == pytest.approx((1 + 10 * mean) / 11)
    assert got[("b", 0)] == pytest.approx(mean)


def test_unseen_group_gets_the_training_mean(spark):
    train = spark.createDataFrame([("a", 2.0), ("b", 4.0)], "g string, y double")
    out = features.apply_target_encoding(spark.createDataFrame([("z",)], "g string"), features.target_encoding(train, "g", "y"), "g").first()
    assert out["unseen"] and out["target_enc"] == pytest.approx(3.0)


def test_pin_claims_match_the_sequential_walk(spark):
    rng = random.Random(9)
    units = [(i, rng.choice(["red ring", "blue bolt", "old gear", "red bolt"]), 6.9 + rng.randrange(12) * 0.0004, 79.9 + rng.randrange(3) * 0.0004) for i in range(90)]
    df = spark.createDataFrame(units, "id long, name string, lat double, lon double")
    got = {r["id"]: r["verdict"] for r in spatial.claim_pins(df, "id", "name", 100.0).collect()}
    from tests.test_plans import hav

    claimed, want = [], {}
    for i, name, lat, lon in units:
        owner = next((c for c in claimed if hav((c[2], c[3]), (lat, lon)) * 1000 * 6371.0 / 6371.0088 <= 100.0), None)
        want[i] = "free" if owner is None else "shared" if set(owner[1].split()) & set(name.split()) else "blocked"
        if want[i] != "blocked":
            claimed.append((i, name, lat, lon))
    assert got == want


def test_quota_replay_matches_the_sequential_walk(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    got = {r["event_id"]: r["accepted"] for r in usage.replay_quota(events, "user_id", "event_id", "ts", 5, 6).collect()}
    taken, frame = {}, events.toPandas().sort_values(["user_id", "ts", "event_id"])
    for row in frame.itertuples():
        window = taken.setdefault(row.user_id, deque())
        while window and window[0] < row.ts - __import__("datetime").timedelta(days=5):
            window.popleft()
        assert got[row.event_id] == (len(window) < 6)
        if len(window) < 6:
            window.append(row.ts)


def test_outside_points_are_labelled_but_priced_by_the_fallback(spark):
    prices = spark.createDataFrame([("fort", "Land_type_A", 60, 15.0), (None, "Land_type_A", 0, 13.0)], "division string, land_type string, listing_count long, log_price double")
    asked = spark.createDataFrame([(1, None, 6.9, 79.8, 10.0, None), (2, None, 7.9, 79.8, 10.0, None), (3, "fort", None, None, 0.0, None), (4, "atlantis", None, None, 3.0, None)],
                                  "id int, division string, lat double, lon double, perches double, land_type string")
    located = lambda df: df.withColumn("loc_division", F.when(F.col("lat") < 7, "fort")).withColumn("loc_nearest", F.lit("fort")).withColumn("loc_inside", F.col("lat") < 7)
    got = {r["id"]: r for r in serving.score(asked, prices, ["Land_type_A"], located).collect()}
    assert got[1]["known_division"] and got[1]["log_price"] == 15.0 and got[1]["confidence"] == "high"
    assert got[2]["division"] == "fort" and not got[2]["known_division"] and got[2]["log_price"] == 13.0
    assert got[3]["error"] and got[3]["total_price"] is None
    assert got[4]["log_price"] == 13.0 and got[4]["small_plot"] and got[4]["total_price"] == pytest.approx(3 * got[4]["price_per_perch"])


def test_shapley_values_add_up(spark):
    df = spark.range(40).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b")).withColumn("y", 2 * F.col("a") - F.col("b"))
    model = modelling.fit_regressor(df, ["a", "b"], "y", "linear")
    out = modelling.shapley_sample(model, df, ["id"], ["a", "b"], 5).toPandas()
    assert out["residual"].abs().max() < 1e-6 and len(out) == 80
    importance = {r["feature"]: r["importance"] for r in modelling.permutation_importance(model, df, ["id"], ["a", "b"], "y").collect()}
    assert importance["a"] > importance["b"] > 0


def test_enforce_raises_with_the_reason(spark):
    df = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(expect.ExpectationFailed, match="unique k"):
        expect.enforce(expect.expect_unique(df, ["k"]))


def test_permutation_importance_over_positions_whose_products_exceed_an_int(spark):
    df = spark.range(60_000).select("id", (F.col("id") % 97).cast("double").alias("a"), (F.col("id") % 13).cast("double").alias("b")).withColumn("y", 3 * F.col("a"))
    model = modelling.fit_regressor(df, ["a", "b"], "y", "linear")
    importance = {r["feature"]: r["importance"] for r in modelling.permutation_importance(model, df, ["id"], ["a", "b"], "y").collect()}
    assert importance["a"] > 1 and abs(importance["b"]) < 1e-6


def test_a_colliding_name_looks_at_the_candidates_around_the_anchor_only(spark):
    rng = np.random.default_rng(3)
    many = [(f"n{i % 2}", i, float(rng.uniform(6, 7)), float(rng.uniform(79, 80))) for i in range(1500)]
    odd = [("one", 5, None, None), ("blank", 8, 6.5, 79.5), ("blank", 9, None, 79.0), ("blank", 7, None, 79.0), ("far", 3, 95.0, 79.0), ("far", 2, 6.0, 79.0), (None, 1, 6.0, 79.0)]
    candidates = spark.createDataFrame([*many, *odd], "name string, owner long, c_lat double, c_lon double")
    rows = [(i, name, a, b) for i, (name, a, b) in enumerate(
        [(f"n{i % 2}", float(rng.uniform(6, 7)), float(rng.uniform(79, 80))) for i in range(200)]
        + [(n, a, b) for n in ("n0", "one", "blank", "far", "nobody", None) for a, b in ((6.4, 79.4), (None, 79.4), (None, None))])]
    rows += [(len(rows), *rows[0][1:])]
    got = {r["id"]: r for r in matching.resolve_collision(
        spark.createDataFrame(rows, "id long, name string, lat double, lon double"), "name", "lat", "lon", candidates, "owner").collect()}
    assert len(got) == len(rows)

    def km(p, q):
        a, b, c, d = map(math.radians, (*p, *q))
        return 2 * 6371 * math.asin(math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2))

    for i, name, lat, lon in rows:
        ours = [c for c in [*many, *odd] if c[0] == name and name is not None]
        missing = lat is None or lon is None
        n = len([c for c in [*many, *odd] if c[0] == name])
        blank = [c[1] for c in ours if missing or c[2] is None or c[3] is None]
        want = min(blank) if blank else min(ours, key=lambda c: (km((lat, lon), c[2:]), c[1]))[1] if ours else None
        assert got[i]["ambiguous"] == (n > 1 and missing), (i, name)
        assert got[i]["owner"] == (None if n > 1 and missing else want), (i, name, lat)


def test_collisions_are_not_compared_with_every_candidate(spark, monkeypatch):
    seen = []
    real = matching.nearest
    monkeypatch.setattr(matching, "nearest", lambda points, *a, **k: seen.append(points.count()) or real(points, *a, **k))
    candidates = spark.range(50).select(F.lit("a").alias("name"), F.col("id").alias("owner"), (F.col("id") / 10).alias("c_lat"), (F.col("id") / 7).alias("c_lon"))
    rows = spark.range(40).select("id", F.lit("a").alias("name"), (F.col("id") / 9).alias("lat"), (F.col("id") / 8).alias("lon"))
    assert matching.resolve_collision(rows, "name", "lat", "lon", candidates, "owner").filter("owner IS NOT NULL").count() == 40 and seen == [40]


def test_loops_over_large_inputs_settle_them_once_and_agree(spark, monkeypatch, tmp_path):
    spark.range(400).select("id", (F.col("id") % 7).cast("double").alias("a"), F.pmod(F.xxhash64("id"), F.lit(11)).cast("double").alias("b"), (F.col("id") % 4).cast("int").alias("fold"),
                            (F.col("id") % 9).alias("g")).withColumn("y", 2 * F.col("a") - F.col("b") + F.col("g") / 3).write.parquet(f"{tmp_path}/rows")
    df = spark.read.parquet(f"{tmp_path}/rows")
    folds_of = lambda d, seed: d.drop("fold").withColumn("fold", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(3)).cast("int"))
    runs = {
        "cv": lambda: modelling.cross_validate(df, ["a", "b"], "y", "fold", "g", "linear"),
        "ablation": lambda: modelling.ablation(df, ["a"], ["b"], "y", folds_of, [1]),
        "rfe": lambda: modelling.rfe_cv(df, ["a", "b"], "y", "fold", "linear"),
        "search": lambda: modelling.random_search_cv(df, ["a", "b"], "y", "fold", "linear", {"fitIntercept": [True, False]}, 2, 4),
    }
    rows = lambda: {name: sorted((tuple(r) for r in run().collect()), key=str) for name, run in runs.items()}
    plain, frozen, real = rows(), [], modelling.freeze
    monkeypatch.setattr(modelling, "freeze", lambda d: frozen.append(d.columns) or real(d))
    monkeypatch.setattr(modelling, "is_small", lambda *a: False)
    large = rows()
    for name, expected in plain.items():
        assert len(expected) == len(large[name])
        for a, b in zip(expected, large[name]):
            assert [x if isinstance(x, str) else pytest.approx(x, rel=1e-9) for x in a] == list(b), name
    assert frozen.count(["a", "b", "y", "fold", "g"]) == 1 and frozen.count(["a", "b", "y", "fold"]) == 3


def test_a_guarded_scan_makes_sound_keys_of_different_tokens_only(spark, monkeypatch):
    frozen, real = [], matching.freeze
    monkeypatch.setattr(matching, "freeze", lambda d: frozen.append(d) or real(d))
    texts = spark.createDataFrame([(1, "near Galle town"), (2, "Galle main road 5"), (3, "no place near Galle"), (4, None), (5, "Galle Galle Road")], "k int, body string")
    places = spark.createDataFrame([("gale", "South")], "place_key string, district string")
    got = {r["k"]: (r["district"], r["token"], r["pos"]) for r in matching.guarded_scan(texts, "k", "body", places, places.select(F.lit("x").alias("key"))).collect()}
    assert got == {1: ("South", "Galle", 1), 3: ("South", "Galle", 3)}
    assert [d.columns for d in frozen] == [["token", "k"], ["token", "district", "how"]]
