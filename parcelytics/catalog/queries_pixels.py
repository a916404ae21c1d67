"""Pixel-table analytics."""

from pyspark.sql import functions as F

from parcelytics.catalog.registry import query
from parcelytics.catalog.registry import rounded as r
from parcelytics.operators import pixels as px

KEYS = ["scene", "x", "y", "qa", "thermal"]


@query("X1_qa_mask", "SELECT scene, x, y, qa, (qa & 31) = 0 AND qa <> 0 AND thermal > 0 AS clear, CAST((qa & 128) <> 0 AS INT) AS water FROM pixels")
def _(t):
    return t.pixels.select("scene", "x", "y", "qa", px.qa_clear(F.col("qa"), F.col("thermal")).alias("clear"), px.qa_water(F.col("qa")).alias("water"))


VALUES = """v AS (SELECT *, CAST(0.0000275 AS DOUBLE) * red - 0.2 AS r, CAST(0.0000275 AS DOUBLE) * nir - 0.2 AS n, CAST(0.0000275 AS DOUBLE) * swir - 0.2 AS s, (qa & 31) = 0 AND qa <> 0 AND thermal > 0 AS clear FROM pixels),
w AS (SELECT scene, x, y, CASE WHEN clear AND n + r <> 0 AND s + n <> 0 THEN (n - r) / (n + r) END AS ndvi, CASE WHEN clear AND n + r <> 0 AND s + n <> 0 THEN (s - n) / (s + n) END AS ndbi,
  CASE WHEN clear AND n + r <> 0 AND s + n <> 0 THEN thermal * CAST(0.00341802 AS DOUBLE) + 149 - CAST(273.15 AS DOUBLE) END AS lst, CASE WHEN clear AND n + r <> 0 AND s + n <> 0 THEN CAST((qa & 128) <> 0 AS INT) END AS water FROM v)"""


@query("X2_band_index", f"""
WITH {VALUES} SELECT scene, count(*) AS n, count(ndvi) AS clear, round(avg(ndbi), 4) AS ndbi, round(avg(lst), 5) AS lst, round(min(lst), 5) AS min_lst, CAST(sum(water) AS BIGINT) AS water FROM w GROUP BY 1""")
def _(t):
    out = px.scene_values(t.pixels).groupBy("scene").agg(
        F.count("*").alias("n"), F.count("ndvi").alias("clear"), F.avg("ndbi").alias("ndbi"), F.avg("lst").alias("lst"), F.min("lst").alias("min_lst"), F.sum("water").alias("water"))
    return out.select("scene", "n", "clear", r("ndbi", 4), r("lst", 5), r("min_lst", 5), "water")


@query("X3_temporal_median", f"""
WITH {VALUES} SELECT x, y, count(ndvi) AS n_clear, round(median(ndvi), 5) AS ndvi, round(median(lst), 5) AS lst, median(water) AS water FROM w GROUP BY 1, 2""")
def _(t):
    out = px.temporal_median(px.scene_values(t.pixels), ["x", "y"], ["ndvi", "lst", "water"])
    return out.select("x", "y", "n_clear", r("ndvi", 5), r("lst", 5), "water")


def zones(t):
    return t.units.select("unit_id", (F.col("unit_id") * 7 % 40).cast("double").alias("cx"), (F.col("unit_id") * 3 % 10).cast("double").alias("cy"))


ZONES = "z AS (SELECT unit_id, CAST(unit_id * 7 % 40 AS DOUBLE) AS cx, CAST(unit_id * 3 % 10 AS DOUBLE) AS cy FROM units)"
NEAR = "(x - cx) * (x - cx) + (y - cy) * (y - cy) <= 2.5 * 2.5"


@query("X4_zonal_mean", f"""
WITH {VALUES}, {ZONES} SELECT unit_id, count(lst) AS n, round(avg(lst), 5) AS mean_lst FROM z LEFT JOIN w ON {NEAR} GROUP BY 1""")
def _(t):
    return px.zonal_mean(px.scene_values(t.pixels), zones(t), "unit_id", 2.5, "lst").select("unit_id", "n", r("mean_lst", 5))


@query("X5_zonal_class_share", f"""
WITH {ZONES}, c AS (SELECT x, y, qa % 7 AS cls FROM pixels WHERE qa % 7 <> 0) SELECT unit_id, count(*) AS n, round(avg(CASE WHEN cls = 3 THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS share FROM z JOIN c ON {NEAR} GROUP BY 1""")
def _(t):
    out = px.zonal_class_share(t.pixels.withColumn("cls", F.col("qa") % 7), zones(t), "unit_id", 2.5, "cls", 3, 0)
    return out.select("unit_id", "n", r("share"))


@query("X6_masked_zonal_mean", f"""
WITH {ZONES}, c AS (SELECT x, y, thermal, qa % 5 <> 2 AS k FROM pixels) SELECT unit_id, round(avg(thermal) FILTER (k), 4) AS mean_thermal, round(100 * count(*) FILTER (NOT k) / CAST(count(*) AS DOUBLE), 6) AS masked_pct FROM z JOIN c ON {NEAR} GROUP BY 1""")
def _(t):
    out = px.masked_zonal_mean(t.pixels, zones(t), "unit_id", 2.5, "thermal", F.col("qa") % 5 != 2)
    return out.select("unit_id", r("mean_thermal", 4), r("masked_pct"))


GRID = "g AS (SELECT x, y, avg(thermal) AS h FROM pixels GROUP BY 1, 2)"


def grid(t):
    return t.pixels.groupBy("x", "y").agg(F.avg("thermal").alias("h"))


@query("X7_slope_from_grid", f"""
WITH {GRID}, s AS (SELECT x, y, h, lag(h) OVER wx AS a, lead(h) OVER wx AS b, lag(h) OVER wy AS c, lead(h) OVER wy AS d FROM g WINDOW wx AS (PARTITION BY y ORDER BY x), wy AS (PARTITION BY x ORDER BY y)),
q AS (SELECT x, y, coalesce((b - a) / (2 * 30), (b - h) / 30, (h - a) / 30, 0) AS gx, coalesce((d - c) / (2 * 30), (d - h) / 30, (h - c) / 30, 0) AS gy FROM s)
SELECT x, y, round(degrees(atan(sqrt(gx * gx + gy * gy))), 5) AS slope_deg FROM q""")
def _(t):
    return px.slope_from_grid(grid(t), "h", 30.0, 30.0).select("x", "y", r("slope_deg", 5))


@query("X8_window_classes", """
WITH p AS (SELECT unit_id, unit_id * 7 % 40 AS px, unit_id * 3 % 10 AS py FROM units), c AS (SELECT x, y, qa % 6 AS cls FROM pixels),
n AS (SELECT unit_id, cls, count(*) AS n, count(*) FILTER (x = px AND y = py) AS here FROM p JOIN c ON x BETWEEN px - 1 AND px + 1 AND y BETWEEN py - 1 AND py + 1 GROUP BY 1, 2)
SELECT unit_id, arg_max(cls, (here, -cls)) FILTER (here > 0) AS point_class, arg_max(cls, (n, -cls)) AS window_mode, max(cls) AS window_max, CAST(sum(n) AS BIGINT) AS window_pixels FROM n GROUP BY 1""")
def _(t):
    points = t.units.select("unit_id", (F.col("unit_id") * 7 % 40).alias("px"), (F.col("unit_id") * 3 % 10).alias("py"))
    return px.window_classes(t.pixels.withColumn("cls", F.col("qa") % 6), points, "unit_id", "cls", 1)


@query("X8_constant_verdict", """SELECT count(DISTINCT qa % 3) AS "distinct", CASE WHEN count(DISTINCT qa % 3) <= 2 THEN 'near constant' WHEN count(DISTINCT qa % 3) <= 3 THEN 'low variance' ELSE 'varies' END AS verdict FROM pixels""")
def _(t):
    return px.constant_verdict(t.pixels.withColumn("cls", F.col("qa") % 3), "cls")


@query("X9_change_detect", """
WITH s AS (SELECT x, y, scene, nir / 500 - 20 AS db FROM pixels), b AS (SELECT x, y, median(db) AS before FROM s WHERE scene < 1998 GROUP BY 1, 2), d AS (SELECT x, y, median(db) AS during FROM s WHERE scene >= 1998 GROUP BY 1, 2)
SELECT x, y, round(before, 5) AS before, round(during, 5) AS during, CAST(during - before < -0.5 AND during < -4 AS INT) AS flag FROM b JOIN d USING (x, y) WHERE (x, y) NOT IN (SELECT (x, y) FROM pixels WHERE qa = 77)""")
def _(t):
    values = t.pixels.select("x", "y", "scene", (F.col("nir") / 500 - 20).alias("db"))
    out = px.change_detect(values, ["x", "y"], "db", F.col("scene") < 1998, F.col("scene") >= 1998, -0.5, -4.0, t.pixels.filter("qa = 77").select("x", "y").distinct())
    return out.select("x", "y", r("before", 5), r("during", 5), "flag")


FOCAL = f"""
WITH {GRID} SELECT a.x, a.y, round(median(b.h), 5) AS focal_h FROM g a JOIN g b ON b.x BETWEEN a.x - RADIUS AND a.x + RADIUS AND b.y BETWEEN a.y - RADIUS AND a.y + RADIUS
  AND (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) <= RADIUS * RADIUS GROUP BY 1, 2"""


@query("X10_focal_median", FOCAL.replace("RADIUS", "1"))
def _(t):
    return px.focal_median(grid(t), "h", 1).select("x", "y", r("focal_h", 5))


@query("X10_focal_median_wide", FOCAL.replace("RADIUS", "4"))
def _(t):
    return px.focal_median(grid(t), "h", 4).select("x", "y", r("focal_h", 5))


ACQ = """ev AS (SELECT n_nationkey AS event, DATE '1996-01-10' + CAST(n_nationkey * 40 AS INT) AS base_from, DATE '1996-01-20' + CAST(n_nationkey * 40 AS INT) AS base_to, DATE '1996-02-05' + CAST(n_nationkey * 40 AS INT) AS flood_from, DATE '1996-02-12' + CAST(n_nationkey * 40 AS INT) AS flood_to, DATE '1996-02-08' + CAST(n_nationkey * 40 AS INT) AS peak FROM nation),
ps AS (SELECT o_custkey % 9 AS orbit, CAST(o_orderdate AS DATE) AS acquired, count(*) AS k FROM orders GROUP BY 1, 2)"""


@query("X11_choose_acquisition", f"""
WITH {ACQ}, j AS (SELECT event, orbit, acquired >= base_from AND acquired < base_to AS b, acquired >= flood_from AND acquired < flood_to AS f, date_diff('day', peak, acquired) AS lag, k FROM ev, ps),
o AS (SELECT event, orbit, coalesce(sum(k) FILTER (b), 0) AS nb, coalesce(sum(k) FILTER (f), 0) AS nf, min(lag) FILTER (f AND lag >= 0) AS aft, max(lag) FILTER (f) AS lst FROM j GROUP BY 1, 2),
q AS (SELECT *, coalesce(aft, lst) AS best, row_number() OVER (PARTITION BY event ORDER BY aft IS NULL, abs(coalesce(aft, lst)), orbit) AS rn FROM o WHERE nb > 0 AND nf > 0)
SELECT ev.event, q.orbit, CAST(nb AS BIGINT) AS n_base, CAST(nf AS BIGINT) AS n_flood, CAST(best AS INT) AS best_lag, q.orbit IS NULL AS skipped FROM ev LEFT JOIN q ON ev.event = q.event AND rn = 1""")
def _(t):
    shift = (F.col("n_nationkey") * 40).cast("int")
    day = lambda text: F.date_add(F.lit(text).cast("date"), shift)
    events = t.nation.select(F.col("n_nationkey").alias("event"), day("1996-01-10").alias("base_from"), day("1996-01-20").alias("base_to"),
                             day("1996-02-05").alias("flood_from"), day("1996-02-12").alias("flood_to"), day("1996-02-08").alias("peak"))
    return px.choose_acquisition(events, t.orders.select((F.col("o_custkey") % 9).alias("orbit"), F.to_date("o_orderdate").alias("acquired")))


MEANS = """e AS (SELECT user_id, avg(value) FILTER (event_type = 'click') / 1000 AS a, avg(value) FILTER (event_type = 'error' AND user_id % 4 <> 0) / 1000 AS b, avg(value) FILTER (event_type = 'view') / 1000 AS c FROM events GROUP BY 1)"""


def event_table(t):
    mean = lambda kind, cond=F.lit(True): F.avg(F.when((F.col("event_type") == kind) & cond, F.col("value"))) / 1000
    return t.events.groupBy("user_id").agg(mean("click").alias("a"), mean("error", F.col("user_id") % 4 != 0).alias("b"), mean("view").alias("c"))


@query("X12_event_mean", f"""
WITH {MEANS} SELECT user_id, round((coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / (CAST(a IS NOT NULL AS INT) + CAST(b IS NOT NULL AS INT) + CAST(c IS NOT NULL AS INT)), 6) AS mean_share,
  coalesce(a > 0, false) AND coalesce(b > 0, false) AND coalesce(c > 0, false) AS all_positive, coalesce(a > 0.01, false) AND coalesce(b > 0.01, false) AND coalesce(c > 0.01, false) AS all_above_1pct FROM e""")
def _(t):
    return px.event_mean(event_table(t), ["a", "b", "c"], "mean_share").select("user_id", r("mean_share"), "all_positive", "all_above_1pct")


@query("X12_event_pairs", f"WITH {MEANS} SELECT 'a' AS a, 'b' AS b, round(corr(a, b), 6) AS r FROM e UNION ALL SELECT 'a', 'c', round(corr(a, c), 6) FROM e UNION ALL SELECT 'b', 'c', round(corr(b, c), 6) FROM e")
def _(t):
    return px.event_pairs(event_table(t), ["a", "b", "c"]).select("a", "b", r("r"))


@query("X13_tag_classify", """
WITH k AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) % 9 AS k FROM events)
SELECT event_id, CASE k WHEN 0 THEN 'school' WHEN 1 THEN 'hospital' WHEN 2 THEN 'supermarket' WHEN 3 THEN 'bank' WHEN 4 THEN 'bus_stop' WHEN 5 THEN 'railway_station' WHEN 6 THEN 'park' WHEN 7 THEN 'school' END AS category FROM k""")
def _(t):
    k = F.get_json_object("props", "$.k").cast("int") % 9
    tags = [("amenity", "school"), ("amenity", "clinic"), ("shop", "convenience"), ("amenity", "atm"), ("highway", "bus_stop"), ("railway", "station"), ("leisure", "park")]
    made = F.create_map(F.lit("shop"), F.lit("supermarket"), F.lit("amenity"), F.lit("school"))
    for i, (tag, value) in enumerate(tags):
        made = F.when(k == i, F.create_map(F.lit(tag), F.lit(value))).otherwise(made)
    made = F.when(k == 8, F.create_map(F.lit("name"), F.lit("x"))).otherwise(made)
    return t.events.select("event_id", px.tag_category(made).alias("category"))
