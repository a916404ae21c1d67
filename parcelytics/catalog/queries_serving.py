"""Serving tables, batch scoring, flood records and admin units."""

from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import functions as F

from parcelytics import fixed_values as fv
from parcelytics.catalog.registry import query
from parcelytics.catalog.registry import rounded as r
from parcelytics.catalog.queries_text import scratch
from parcelytics.functions import geo
from parcelytics.operators import expect, modelling as ml, serving as sv
from parcelytics.operators import spatial as sp

TYPES = ["Land_type_A_F", "Land_type_N_O", "Land_type_R_F"]
COLUMNS = ["land_size", "discount", "tax"]


def tables(t):
    train = t.listings.filter("division % 10 <> 9").withColumn("y", F.log("unit_price"))
    return sv.build_serving_tables(train, "division", "y", COLUMNS, ["land_size", "discount", "tax", *TYPES, "target_enc"])


def lookup_mean_model(rows):
    """Stand-in regressor of the oracle: encoding plus fixed effects."""
    return rows.withColumn("log_price", F.col("target_enc") - 0.01 * F.col("land_size") + F.col("discount") + 0.05 * F.col("Land_type_N_O") - 0.02 * F.col("Land_type_R_F"))


SERVING = """tr AS (SELECT *, ln(unit_price) AS y FROM listings WHERE division % 10 <> 9), mu AS (SELECT avg(y) AS mean FROM tr),
lk AS (SELECT division, count(*) AS n, median(land_size) AS land_size, median(discount) AS discount, median(tax) AS tax, (sum(y) + 10 * any_value(mean)) / (count(*) + 10) AS enc FROM tr, mu GROUP BY 1),
gl AS (SELECT median(land_size) AS land_size, median(discount) AS discount, median(tax) AS tax FROM lk),
ty AS (SELECT unnest(['Land_type_A_F', 'Land_type_N_O', 'Land_type_R_F']) AS land_type, unnest([0, 0.05, -0.02])::DOUBLE AS eff),
pr AS (SELECT division, land_type, n, enc - CAST(0.01 AS DOUBLE) * 12 + discount + eff AS lp FROM lk, ty), fb AS (SELECT land_type, mean - CAST(0.01 AS DOUBLE) * 12 + discount + eff AS lp FROM gl, mu, ty)"""


@query("P1_build_serving_tables", f"""
WITH {SERVING} SELECT lk.division, n AS listing_count, land_size, round(discount, 6) AS discount, round(tax, 6) AS tax, round(enc, 6) AS target_enc, round(mean, 6) AS global_mean FROM lk, mu""")
def _(t):
    path = scratch(t, "serving")
    tables(t).write(path)
    back = sv.ServingTables.read(t.spark, path)
    mean = back.fallback.select("global_mean_log_price")
    out = back.lookup.join(back.encoding, "division").withColumn("global_mean", mean.scalar())
    return out.select("division", "listing_count", "land_size", r("discount"), r("tax"), r("target_enc"), r("global_mean"))


def requests(t):
    k = F.col("request_id")
    kind = F.element_at(F.array(*[F.lit(v) for v in [*TYPES, "Land_type_X"]]), (k % 4 + 1).cast("int"))
    return t.requests.select("request_id", (F.col("division") % 150).alias("division"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"),
                             F.when(k % 13 == 0, 0.0).otherwise(F.col("perches")).alias("perches"), F.when(k % 11 != 0, kind).alias("land_type"))


REQUESTS = """rq AS (SELECT request_id, division % 150 AS division, CASE WHEN request_id % 13 = 0 THEN 0 ELSE perches END AS perches,
  CASE WHEN request_id % 11 = 0 THEN 'Land_type_A_F' ELSE ['Land_type_A_F', 'Land_type_N_O', 'Land_type_R_F', 'Land_type_X'][CAST(request_id % 4 + 1 AS INT)] END AS land_type FROM requests),
sc AS (SELECT rq.*, pr.n, pr.lp IS NOT NULL AS known, CASE WHEN NOT perches > 0 THEN 'perches must be a positive number' WHEN rq.land_type = 'Land_type_X' THEN 'unknown land type' END AS error, coalesce(pr.lp, fb.lp) AS lp
  FROM rq LEFT JOIN pr ON rq.division = pr.division AND rq.land_type = pr.land_type LEFT JOIN fb ON rq.land_type = fb.land_type)"""


@query("P2_score", f"""
WITH {SERVING}, {REQUESTS} SELECT request_id, division, land_type, known AS known_division, coalesce(n, 0) AS listing_count, CASE WHEN n >= 50 THEN 'high' WHEN n >= 10 THEN 'medium' WHEN n >= 1 THEN 'low' ELSE 'none' END AS confidence,
  round(CASE WHEN error IS NULL THEN exp(lp) END, 4) AS price_per_perch, round(CASE WHEN error IS NULL THEN exp(lp) * perches END, 3) AS total_price, perches < 6 AS small_plot, error FROM sc""")
def _(t):
    prices = sv.price_table(tables(t), TYPES, lookup_mean_model)
    out = sv.score(requests(t), prices, TYPES)
    return out.select("request_id", "division", "land_type", "known_division", "listing_count", "confidence", r("price_per_perch", 4), r("total_price", 3), "small_plot", "error")


@query("P2_score_points", f"""
WITH h AS (SELECT p.point_id, arg_min(b.address, b.poly_id) FILTER (modelled) AS m FROM points p LEFT JOIN boxes b ON p.lat >= b.y0 AND p.lat < b.y1 AND p.lon >= b.x0 AND p.lon < b.x1 GROUP BY 1)
SELECT point_id, m IS NOT NULL AS known_division, CASE WHEN m IS NOT NULL THEN m END AS inside FROM h""")
def _(t):
    boxes = t.boxes.withColumn("c_lat", (F.col("y0") + F.col("y1")) / 2).withColumn("c_lon", (F.col("x0") + F.col("x1")) / 2)
    located = lambda df: df.join(sv.request_points(sp.locate(df.select("point_id", "lat", "lon"), boxes, "poly_id"), ["point_id"]), "point_id")
    prices = t.boxes.filter("modelled").select(F.col("address").alias("division"), F.lit("Land_type_A_F").alias("land_type"), F.lit(60).alias("listing_count"), F.lit(14.0).alias("log_price"))
    fallback = prices.limit(1).select(F.lit(None).cast("string").alias("division"), "land_type", F.lit(0).alias("listing_count"), F.lit(13.0).alias("log_price"))
    asked = t.points.select("point_id", "lat", "lon", F.lit(None).cast("string").alias("division"), F.lit(10.0).alias("perches"), F.lit("Land_type_A_F").alias("land_type"))
    out = sv.score(asked, prices.unionByName(fallback), ["Land_type_A_F"], located)
    return out.select("point_id", "known_division", F.when(F.col("known_division"), F.col("division")).alias("inside"))


@query("P3_compare_categories", f"""
WITH {SERVING}, rq AS (SELECT request_id, division % 150 AS division, perches FROM requests), s AS (SELECT request_id, fb.land_type, exp(coalesce(pr.lp, fb.lp)) AS p, pr.lp IS NOT NULL AS known FROM rq JOIN fb ON true LEFT JOIN pr ON rq.division = pr.division AND fb.land_type = pr.land_type)
SELECT request_id, land_type, replace(substring(land_type, 11), '_', ' / ') AS land_type_label, known AS known_division, round(p, 4) AS price_per_perch, CAST(row_number() OVER (PARTITION BY request_id ORDER BY p, land_type) AS INT) AS position FROM s""")
def _(t):
    prices = sv.price_table(tables(t), TYPES, lookup_mean_model)
    asked = requests(t).withColumn("perches", F.lit(10.0))
    out = sv.compare_categories(asked, "request_id", prices, TYPES)
    return out.select("request_id", "land_type", "land_type_label", "known_division", r("price_per_perch", 4), "position")


@query("P4_risk_profile", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_orderkey % 6 <> 0 THEN discount END AS hand_m, tax AS ndvi FROM listings""")
def _(t):
    df = t.listings.select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_orderkey") % 6 == 0, float("nan")).otherwise(F.col("discount")).alias("hand_m"), F.col("tax").alias("ndvi"))
    return sv.risk_profile(df, ["l_orderkey", "l_linenumber", "l_partkey"], ["hand_m", "ndvi"])


UNITS = """fu AS (SELECT user_id, avg(CASE WHEN event_type = 'error' THEN value END) / 100 AS s1, avg(CASE WHEN event_type = 'click' THEN value END) / 400 AS s2, count(*) FILTER (event_type = 'view') / CAST(60 AS DOUBLE) AS c1, count(*) FILTER (event_type = 'signup') / CAST(80 AS DOUBLE) AS c2,
  count(DISTINCT day(ts)) FILTER (event_type = 'error' AND value > 60) AS ny FROM events GROUP BY 1)"""


def flood_units(t):
    kind, value = F.col("event_type"), F.col("value")
    return t.events.groupBy("user_id").agg(
        (F.avg(F.when(kind == "error", value)) / 100).alias("flooded_share_a"), (F.avg(F.when(kind == "click", value)) / 400).alias("flooded_share_b"),
        (F.count_if(kind == "view") / 60).alias("covered_a"), (F.count_if(kind == "signup") / 80).alias("covered_b"),
        F.array_join(F.transform(F.array_sort(F.collect_set(F.when((kind == "error") & (value > 60), F.dayofmonth("ts")))), lambda d: d.cast("string")), " ").alias("years_text"))


@query("P5_event_record", f"""
WITH {UNITS}, d AS (SELECT user_id, array_to_string(list_sort(list_distinct(list(day(ts)))), ' ') AS years FROM events WHERE event_type = 'error' AND value > 60 GROUP BY 1)
SELECT fu.user_id, CASE WHEN c1 > 0.5 THEN round(s1 * 100, 1) END AS flooded_pct_a, CASE WHEN c2 > 0.5 THEN round(s2 * 100, 1) END AS flooded_pct_b, coalesce(years, '') AS years FROM fu LEFT JOIN d ON fu.user_id = d.user_id""")
def _(t):
    out = sv.event_record(flood_units(t), ["a", "b"], ["user_id"], "years_text")
    return out.select("user_id", "flooded_pct_a", "flooded_pct_b", F.array_join(F.transform("years", lambda y: y.cast("string")), " ").alias("years"))


@query("P6_indication", f"""
WITH {UNITS}, e AS (SELECT *, coalesce(CAST(s1 >= 0.01 AS INT), 0) + coalesce(CAST(s2 >= 0.01 AS INT), 0) + CASE WHEN user_id % 3 = 0 THEN ny ELSE 0 END AS events, greatest(s1, s2) AS mx FROM fu)
SELECT user_id, CAST(events AS BIGINT) AS events, round(mx, 6) AS max_share, CASE WHEN mx >= 0.25 OR events >= 3 THEN 'High' WHEN events >= 1 THEN 'Medium' WHEN c1 > 0.5 OR c2 > 0.5 THEN 'Low' ELSE 'No official record' END AS indication FROM e""")
def _(t):
    n = F.when(F.col("user_id") % 3 == 0, F.size(F.filter(F.split("years_text", " "), lambda y: y != ""))).otherwise(0)
    out = sv.indication(flood_units(t), ["a", "b"], n)
    return out.select("user_id", F.col("events").cast("long").alias("events"), r("max_share"), "indication")


AREA = f"abs(radians(x1 - x0) * (2 + sin(radians(y0)) + sin(radians(y0))) + radians(x0 - x1) * (2 + sin(radians(y1)) + sin(radians(y1)))) * CAST({fv.SERVING_RADIUS_M} AS DOUBLE) * CAST({fv.SERVING_RADIUS_M} AS DOUBLE) / 2"


@query("P7_spherical_ring_area", f"SELECT poly_id, round({AREA} / 1000000, 5) AS km2, round({AREA} / CAST(25.29285 AS DOUBLE) / 1000, 4) AS kiloperches, CAST(0 AS DOUBLE) AS degenerate FROM boxes")
def _(t):
    ring = F.col("rings")[0]
    area = geo.spherical_ring_area(ring)
    return t.boxes.select("poly_id", r(area / 1e6, 5).alias("km2"), r(geo.m2_to_perches(area) / 1000, 4).alias("kiloperches"),
                          geo.spherical_ring_area(F.slice(ring, 1, 2)).alias("degenerate"))


def members(t):
    return t.boxes.select((F.col("poly_id") % 8).alias("unit"), "poly_id", "address", (F.col("poly_id") % 3).cast("string").alias("parent"), "rings", "x0", "y0", "x1", "y1")


@query("P8_assemble_units", f"""
SELECT poly_id % 8 AS unit, CAST(count(*) AS INT) AS n_rings, string_agg(address, '; ' ORDER BY address) AS members, array_to_string(list_sort(list_distinct(list(CAST(poly_id % 3 AS VARCHAR)))), '; ') AS parents, poly_id % 8 < 6 AS modelled,
  round(min(x0), 6) AS min_lon, round(max(y1), 6) AS max_lat, round(sum({AREA}) / 1000000, 4) AS area_km2 FROM boxes GROUP BY poly_id % 8""")
def _(t):
    known = t.boxes.select((F.col("poly_id") % 8).alias("unit")).filter("unit < 6")
    out = sv.assemble_units(members(t), "unit", "poly_id", "address", "parent", known)
    return out.select("unit", F.size("rings").alias("n_rings"), F.array_join("members", "; ").alias("members"), F.array_join("parents", "; ").alias("parents"), "modelled",
                      r(F.col("bbox.min_lon")).alias("min_lon"), r(F.col("bbox.max_lat")).alias("max_lat"), r("area_km2", 4))


@query("P9_publish_checks", """
SELECT 'no polygon' AS "check", CAST(0 AS BIGINT) AS n, true AS fatal, true AS ok UNION ALL SELECT 'encoded without centroid', 1, true, false UNION ALL SELECT 'centroid without encoding', 2, false, true
UNION ALL SELECT 'polygon claimed twice', 0, true, true UNION ALL SELECT 'no stated area', 1, true, false UNION ALL SELECT 'area off', count(*), true, count(*) = 0 FROM (SELECT DISTINCT poly_id % 8 AS u FROM boxes WHERE poly_id % 8 = 2)""")
def _(t):
    units = t.boxes.select((F.col("poly_id") % 8).alias("unit")).distinct()
    stated = sv.assemble_units(members(t), "unit", "poly_id", "address", "parent", units).select(
        "unit", (F.col("area_km2") * F.when(F.col("unit") == 2, 1.05).otherwise(1.0)).alias("area_sqkm")).filter("unit <> 4")
    out = sv.publish_checks(members(t), "unit", "poly_id", units.filter("unit <> 1"), units.filter("unit NOT IN (0, 5)"), stated, "area_sqkm")
    return out.select("check", "n", "fatal", "ok")


@query("S6_expect_area", """
SELECT 'area of poly_id' AS "check", true AS ok, concat_ws(' ', count(*) FILTER (poly_id < 0), 'units off, worst', '0.0') AS detail FROM boxes""")
def _(t):
    stated = t.boxes.withColumn("stated", geo.spherical_ring_area(F.col("rings")[0]))
    return expect.expect_area(stated, "poly_id", "rings", "stated")


@query("P10_ring_centroid", "SELECT poly_id, round((x0 + x1 + x1 + x0) / 4, 6) AS lon, round((y0 + y0 + y1 + y1) / 4, 6) AS lat FROM boxes")
def _(t):
    out = t.boxes.select("poly_id", geo.ring_centroid(F.col("rings")[0]).alias("c"))
    return out.select("poly_id", r(F.col("c.lon")).alias("lon"), r(F.col("c.lat")).alias("lat"))


@query("P2_score_fitted_with_record", f"""
WITH {SERVING}, fit AS (SELECT regr_slope(enc - CAST(0.01 AS DOUBLE) * land_size, enc) AS k, regr_intercept(enc - CAST(0.01 AS DOUBLE) * land_size, enc) AS c FROM lk),
rec AS (SELECT division, avg(land_size) AS hazard, avg(discount) * 5 AS flooded, avg(tax) * 15 AS covered, min(l_linenumber) AS since FROM listings GROUP BY 1),
rq AS (SELECT request_id, 'unit ' || (division % 150) AS division, division % 150 AS d, perches FROM requests)
SELECT request_id, rq.division, lk.division IS NOT NULL AS known_division, round(exp(c + k * coalesce(enc, mean)), 4) AS price_per_perch, round(hazard, 6) AS hazard,
  CASE WHEN covered > 0.5 THEN round_even(flooded * 100, 1) END AS flooded_pct_a, since AS first_year
FROM rq CROSS JOIN fit CROSS JOIN mu LEFT JOIN lk ON lk.division = rq.d LEFT JOIN rec ON rec.division = rq.d""")
def _(t):
    """Names in any case and with blanks, a linear model that was saved and loaded again, risk and flood record of the unit."""
    built = tables(t)
    name = lambda c: F.concat(F.lit("unit "), F.col(c).cast("string"))
    built.encoding, built.lookup = built.encoding.withColumn("division", name("division")), built.lookup.withColumn("division", name("division"))
    train = built.lookup.join(built.encoding, "division").withColumn("label", F.col("target_enc") - 0.01 * F.col("land_size"))
    path = scratch(t, "model")
    sv.save_model(ml.fit_regressor(train, ["target_enc"], "label", "linear"), path)
    prices = sv.price_table(built, TYPES, sv.load_predictor(LinearRegressionModel, path, ["target_enc"]))
    units = t.listings.groupBy(name("division").alias("division")).agg(
        F.avg("land_size").alias("hazard"), (F.avg("discount") * 5).alias("flooded_share_a"), (F.avg("tax") * 15).alias("covered_a"), F.min("l_linenumber").cast("string").alias("years"))
    records = sv.risk_profile(units, ["division"], ["hazard"]).join(sv.event_record(units, ["a"], ["division"], "years"), "division")
    k = F.col("request_id") % 3
    plain = name("asked")
    asked = t.requests.withColumn("asked", F.col("division") % 150).select(
        "request_id", F.when(k == 0, plain).when(k == 1, F.upper(plain)).otherwise(F.concat(F.lit("  "), F.initcap(plain), F.lit(" "))).alias("division"),
        F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), "perches", F.lit(TYPES[0]).alias("land_type"))
    out = sv.score(asked, prices, TYPES, records=records)
    return out.select("request_id", "division", "known_division", r("price_per_perch", 4), r("hazard"), "flooded_pct_a", F.get("years", 0).cast("long").alias("first_year"))
