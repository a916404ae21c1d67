"""Engineered features, encodings and screening."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from parcelytics.catalog.registry import query
from parcelytics.catalog.registry import rounded as r
from parcelytics.operators import aggregates, features as ft

TOTAL = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "total_price", "discount", "tax"]
TOTALS = ", ".join(TOTAL)
TYPES = ["A_F", "A_O", "N_F", "N_O", "R_F", "R_O"]


@query("H1_row_aggregates", f"""
WITH w AS (SELECT *, CASE WHEN l_orderkey % 5 <> 0 THEN land_size END AS c1, l_linenumber AS c2, CASE WHEN l_orderkey % 3 <> 0 THEN discount END AS d1, tax AS d2 FROM listings)
SELECT {TOTALS}, coalesce(c1, 0) + c2 AS total_amenity_count, least(d1, d2) AS min_dist_any_amenity, c1 + c2 AS school_count_total FROM w""")
def _(t):
    wide = t.listings.select(
        *TOTAL, F.when(F.col("l_orderkey") % 5 != 0, F.col("land_size")).alias("count_a"), F.col("l_linenumber").alias("count_b"),
        F.when(F.col("l_orderkey") % 3 != 0, F.col("discount")).alias("min_dist_a"), F.col("tax").alias("min_dist_b"))
    out = ft.row_aggregates(wide, {"school_count_total": ["count_a", "count_b"]})
    return out.select(*TOTAL, "total_amenity_count", "min_dist_any_amenity", "school_count_total")


@query("H2_interaction_features", f"""
WITH w AS (SELECT *, CASE WHEN l_orderkey % 5 <> 0 THEN land_size END AS maybe FROM listings), s AS (SELECT median(maybe) AS md, avg(discount) AS m1, stddev_samp(discount) AS s1, avg(tax) AS m2, stddev_samp(tax) AS s2 FROM w)
SELECT {TOTALS}, round(land_size / (discount + CAST(0.1 AS DOUBLE)), 6) AS density, round(land_size * discount, 6) AS product, count(*) OVER (PARTITION BY division) AS group_freq, coalesce(maybe, md) AS maybe_filled,
  round((discount - m1) / (s1 + CAST(1e-9 AS DOUBLE)) - (tax - m2) / (s2 + CAST(1e-9 AS DOUBLE)), 5) AS risk_score FROM w, s""")
def _(t):
    df = t.listings.withColumn("maybe", F.when(F.col("l_orderkey") % 5 != 0, F.col("land_size")))
    out = ft.interaction_features(df, "division", ("land_size", "discount"), ("land_size", "discount"), "maybe", {"discount": 1, "tax": -1})
    return out.select(*TOTAL, r("density"), r("product"), "group_freq", "maybe_filled", r("risk_score", 5))


@query("H3_one_hot", f"SELECT {TOTALS}, " + ", ".join(f"CAST(coalesce(land_type = '{v}', false) AS INT) AS \"Land_type_{v}\"" for v in TYPES) + " FROM (SELECT * REPLACE (CASE WHEN l_orderkey % 9 <> 0 THEN land_type END AS land_type) FROM listings)")
def _(t):
    df = t.listings.withColumn("land_type", F.when(F.col("l_orderkey") % 9 != 0, F.col("land_type")))
    out = ft.one_hot(df, "land_type", TYPES, "Land_type")
    return out.select(*TOTAL, *[f"Land_type_{v}" for v in TYPES])


@query("H4_target_encode_oof", f"""
WITH y AS (SELECT *, ln(unit_price) AS y FROM listings), g AS (SELECT l_partkey AS g, fold AS f, sum(y) AS s, count(y) AS c FROM y GROUP BY 1, 2), tot AS (SELECT g, sum(s) AS gs, sum(c) AS gc FROM g GROUP BY 1), mu AS (SELECT avg(y) AS mean FROM y)
SELECT {TOTALS}, round(CASE WHEN gc - c = 0 THEN mean ELSE (gs - s + 10 * mean) / (gc - c + 10) END, 6) AS target_enc FROM y JOIN g ON l_partkey = g.g AND fold = g.f JOIN tot ON g.g = tot.g, mu""")
def _(t):
    df = t.listings.withColumn("y", F.log("unit_price"))
    return ft.target_encode_oof(df, "l_partkey", "y", "fold").select(*TOTAL, r("target_enc"))


@query("H5_target_encode_full", f"""
WITH y AS (SELECT *, ln(unit_price) AS y FROM listings), tr AS (SELECT * FROM y WHERE fold <> 0), mu AS (SELECT avg(y) AS mean FROM tr), e AS (SELECT l_partkey, (sum(y) + 10 * any_value(mean)) / (count(*) + 10) AS enc FROM tr, mu GROUP BY 1)
SELECT {TOTALS}, round(coalesce(enc, mean), 6) AS target_enc, enc IS NULL AS unseen FROM (SELECT * FROM y WHERE fold = 0) v LEFT JOIN e ON v.l_partkey = e.l_partkey, mu""".replace(f"SELECT {TOTALS}, round(coalesce", "SELECT v." + ", v.".join(TOTAL) + ", round(coalesce"))
def _(t):
    df = t.listings.withColumn("y", F.log("unit_price"))
    encoding = ft.target_encoding(df.filter("fold <> 0"), "l_partkey", "y")
    return ft.apply_target_encoding(df.filter("fold = 0"), encoding, "l_partkey").select(*TOTAL, r("target_enc"), "unseen")


@query("H6_assemble", f"SELECT {TOTALS}, land_size AS f0, coalesce(CASE WHEN l_orderkey % 3 <> 0 THEN discount END, 0) AS f1, CAST(0 AS DOUBLE) AS f2, tax AS f3 FROM listings")
def _(t):
    df = t.listings.withColumn("sparse", F.when(F.col("l_orderkey") % 3 != 0, F.col("discount")))
    out = ft.assemble(df, ["land_size", "sparse", "not_there", "tax"], keep=TOTAL).withColumn("a", vector_to_array("features"))
    return out.select(*TOTAL, *[F.col("a")[i].alias(f"f{i}") for i in range(4)])


@query("H7_standardize", f"""
SELECT {TOTALS}, round((land_size - avg(land_size) OVER ()) / stddev_pop(land_size) OVER (), 6) AS z_size, round((unit_price - avg(unit_price) OVER ()) / stddev_pop(unit_price) OVER (), 6) AS z_price FROM listings""")
def _(t):
    df = t.listings.select(*TOTAL, F.col("land_size").alias("z_size"), F.col("unit_price").alias("z_price"))
    return ft.standardize(df, ["z_size", "z_price"]).select(*TOTAL, r("z_size"), r("z_price"))


UNIT = """u AS (SELECT division, avg(land_size) AS size, avg(total_price) AS total, avg(unit_price) AS price, min(l_linenumber) AS few, avg(discount) AS disc, avg(tax) AS tax FROM listings GROUP BY 1)"""


def unit_table(t):
    return t.listings.groupBy("division").agg(
        F.avg("land_size").alias("size"), F.avg("total_price").alias("total"), F.avg("unit_price").alias("price"), F.min("l_linenumber").alias("few"),
        F.avg("discount").alias("disc"), F.avg("tax").alias("tax"))


def screen_sql(name, rejected=False):
    verdict = "'REJECT'" if rejected else f"CASE WHEN count(DISTINCT {name}) < 30 OR abs(corr({name}, size)) > 0.8 THEN 'DROP' ELSE 'KEEP' END"
    return f"""SELECT '{name}' AS feature, count(*) - count({name}) AS nulls, count(DISTINCT {name}) AS "distinct", round(CAST(min({name}) AS DOUBLE), 4) AS min, round(CAST(max({name}) AS DOUBLE), 4) AS max,
      {verdict} AS verdict FROM u"""


@query("H8_screen_features", f"WITH {UNIT} " + " UNION ALL ".join([screen_sql("total"), screen_sql("price"), screen_sql("few"), screen_sql("disc"), screen_sql("tax", True)]))
def _(t):
    out = ft.screen_features(unit_table(t), ["total", "price", "few", "disc", "tax"], "size", {"tax": "listed as unusable"})
    return out.select("feature", "nulls", "distinct", r("min", 4), r("max", 4), "verdict")


PREFER = ["tax", "total", "size", "price", "disc"]


def h9_sql():
    """Pairs by strength; each drops its less preferred column unless one of them is gone; size and tax stand already."""
    names = ["disc", "price", "size", "tax", "total"]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    each = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM u" for a, b in pairs)
    place = lambda c: f"list_position({PREFER!r}, {c})"
    loser = f"""CASE WHEN (a IN ('size', 'tax')) <> (b IN ('size', 'tax')) THEN CASE WHEN a IN ('size', 'tax') THEN b ELSE a END
      WHEN {place('a')} <= {place('b')} THEN b ELSE a END"""
    return f"""
WITH RECURSIVE {UNIT}, p AS ({each}), s AS (SELECT a, b, r, row_number() OVER (ORDER BY abs(r) DESC, a, b) AS rn FROM p WHERE abs(r) > 0.005),
c AS (SELECT *, CASE WHEN a IN ('size', 'tax') AND b IN ('size', 'tax') OR a = 'disc' AND b = 'price' THEN NULL ELSE {loser} END AS out FROM s),
w AS (SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS VARCHAR[]) AS gone, false AS taken
  UNION ALL SELECT c.rn, CASE WHEN list_contains(gone, a) OR list_contains(gone, b) OR out IS NULL THEN gone ELSE list_append(gone, out) END, NOT (list_contains(gone, a) OR list_contains(gone, b))
  FROM w JOIN c ON c.rn = w.rn + 1)
SELECT a AS first, b AS second, round(r, 6) AS r, CASE WHEN out IS NULL THEN 'flagged' ELSE 'dropped' END AS action, out AS loser FROM c JOIN w ON c.rn = w.rn WHERE taken"""


@query("H9_resolve_collinear", h9_sql())
def _(t):
    names = ["disc", "price", "size", "tax", "total"]
    pairs = aggregates.corr_matrix(unit_table(t), names)
    out = ft.resolve_collinear(pairs, names, PREFER, existing=["size", "tax"], flag_only=[("disc", "price")], r_max=0.005)
    swap = F.col("a") < F.col("b")
    return out.select(F.when(swap, F.col("a")).otherwise(F.col("b")).alias("first"), F.when(swap, F.col("b")).otherwise(F.col("a")).alias("second"), r("r"), "action", "loser")


@query("H10_physical_consistency", f"""
WITH {UNIT} SELECT 'total' AS variable, round(corr(total, size), 6) AS r, sign(corr(total, size)) = 1 AND abs(corr(total, size)) >= 0.05 AS agrees, min(total) >= 0 AND max(total) <= 100000 AS in_range,
  sign(corr(total, size)) = 1 AND abs(corr(total, size)) >= 0.05 AND min(total) >= 0 AND max(total) <= 100000 AS passes FROM u
UNION ALL SELECT 'disc', round(corr(disc, tax), 6), sign(corr(disc, tax)) = 1 AND abs(corr(disc, tax)) >= 0.5, min(disc) >= 0 AND max(disc) <= 0.2, sign(corr(disc, tax)) = 1 AND abs(corr(disc, tax)) >= 0.5 AND min(disc) >= 0 AND max(disc) <= 0.2 FROM u""")
def _(t):
    out = ft.physical_consistency(unit_table(t), {
        "total": {"ref": "size", "sign": 1, "r_min": 0.05, "lo": 0, "hi": 100000}, "disc": {"ref": "tax", "sign": 1, "r_min": 0.5, "lo": 0, "hi": 0.2}})
    return out.select("variable", r("r"), "agrees", "in_range", "passes")


@query("H11_group_rank_test", """
WITH u AS (SELECT division, avg(land_size) AS v, CASE division % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 2 THEN 'control' END AS role FROM listings GROUP BY 1), k AS (SELECT *, rank() OVER (ORDER BY v DESC) AS rk FROM u),
m AS (SELECT count(v) AS n, avg(rk) FILTER (role = 'high') AS h, avg(rk) FILTER (role = 'low') AS l, avg(rk) FILTER (role = 'control') AS c FROM k)
SELECT n, round(h, 4) AS high_rank, round(l, 4) AS low_rank, round(c, 4) AS control_rank, CASE WHEN h < l THEN 'PASS' ELSE 'FAIL' END AS separation, CASE WHEN c < h THEN 'FAIL' ELSE 'PASS' END AS control FROM m""")
def _(t):
    units = t.listings.groupBy("division").agg(F.avg("land_size").alias("v"))
    role = F.when(F.col("division") % 4 == 0, "high").when(F.col("division") % 4 == 1, "low").when(F.col("division") % 4 == 2, "control")
    out = ft.group_rank_test(units, "division", "v", role)
    return out.select("n", r("high_rank", 4), r("low_rank", 4), r("control_rank", 4), "separation", "control")


@query("H12_sensitivity_flip", f"""
WITH {UNIT}, c AS (SELECT corr(total, size) AS a, corr(price, size) AS b FROM u)
SELECT round(a, 6) AS r_base, round(b, 6) AS r_alternative, abs(a) <= 0.3 AS base_passes, abs(b) <= 0.3 AS alternative_passes, (abs(a) <= 0.3) <> (abs(b) <= 0.3) AS flips FROM c""")
def _(t):
    out = ft.sensitivity_flip(unit_table(t), "total", "price", "size", 0.3)
    return out.select(r("r_base"), r("r_alternative"), "base_passes", "alternative_passes", "flips")


@query("H13_join_survivors", f"""
WITH {UNIT}, v AS (SELECT * FROM u WHERE division % 5 <> 0), j AS (SELECT l.division, v.size, v.disc FROM listings l LEFT JOIN v ON l.division = v.division)
SELECT 'size' AS feature, count(*) - count(size) AS nulls, count(*) AS rows FROM j UNION ALL SELECT 'disc', count(*) - count(disc), count(*) FROM j""")
def _(t):
    return ft.join_survivors(t.listings, unit_table(t).filter("division % 5 <> 0"), "division", ["size", "disc"])[1]


@query("H14_compare_extractions", """
WITH a AS (SELECT division, avg(land_size) AS v FROM listings WHERE fold < 3 GROUP BY 1), b AS (SELECT division, avg(land_size) AS v FROM listings WHERE fold >= 2 GROUP BY 1)
SELECT count(*) AS n, round(corr(a.v, b.v), 6) AS r, round(avg(abs(a.v - b.v)), 6) AS mean_abs_diff FROM a JOIN b USING (division)""")
def _(t):
    part = lambda where: t.listings.filter(where).groupBy("division").agg(F.avg("land_size").alias("v"))
    out = ft.compare_extractions(part("fold < 3"), part("fold >= 2"), "division", "v")
    return out.select("n", r("r"), r("mean_abs_diff"))
