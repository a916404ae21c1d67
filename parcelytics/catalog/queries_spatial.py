"""Distances, proximity, location lookup, hit selection, pin checks and polygon work."""

from pyspark.sql import functions as F

from parcelytics import fixed_values as fv
from parcelytics.catalog.registry import query
from parcelytics.catalog.registry import rounded as r
from parcelytics.catalog.views import haversine_sql
from parcelytics.functions import geo
from parcelytics.operators import spatial as sp

HAV = haversine_sql("p.lat", "p.lon", "q.lat", "q.lon", fv.FEATURE_RADIUS_KM)
BRANDS = [f"Brand#{i}" for i in range(1, 26)]


def as_targets(df, *keep):
    return df.select(F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon"), *keep)


@query("D16_haversine", f"""
WITH n AS (SELECT count(*) AS n FROM units)
SELECT p.point_id, q.unit_id, round({HAV}, 6) AS km FROM points p CROSS JOIN n JOIN units q ON p.point_id % n = q.unit_id % n""")
def _(t):
    """Every point with one unit: the pairs grow with the points."""
    n = t.units.agg(F.count("*")).scalar()
    units = t.units.select((F.col("unit_id") % n).alias("pair"), "unit_id", F.col("lat").alias("a"), F.col("lon").alias("o"))
    return t.points.withColumn("pair", F.col("point_id") % n).join(units, "pair").select("point_id", "unit_id", r(geo.haversine(F.col("lat"), F.col("lon"), F.col("a"), F.col("o"))).alias("km"))


@query("D17_distance_to_point", f"SELECT point_id, round({haversine_sql('lat', 'lon', '6.9333', '79.8433', fv.FEATURE_RADIUS_KM)}, 6) AS km FROM points")
def _(t):
    return t.points.select("point_id", r(geo.distance_to_point(F.col("lat"), F.col("lon"))).alias("km"))


@query("D18_nearest", f"SELECT point_id, round(min({HAV}), 6) AS km FROM points p, units q GROUP BY 1")
def _(t):
    return sp.nearest_km(t.points, as_targets(t.units)).select("point_id", r("km"))


@query("D18_nearest_per_category", f"""
SELECT p.point_id, p.category, round(min({HAV}), 6) AS km FROM (SELECT point_id, lat, lon, unnest({BRANDS + ['none']}) AS category FROM points) p
LEFT JOIN amenities q ON p.category = q.category GROUP BY 1, 2""")
def _(t):
    out = sp.nearest_km(t.points, as_targets(t.amenities, "category"), "category", [*BRANDS, "none"])
    return out.select("point_id", "category", r("km"))


@query("D19_count_within", f"SELECT p.point_id, count(q.amenity_id) AS n FROM points p LEFT JOIN amenities q ON {HAV} <= 2.0 GROUP BY 1")
def _(t):
    return sp.targets_within(t.points, as_targets(t.amenities), 2.0).select("point_id", "n")


@query("D20_proximity_features", f"""
WITH d AS (SELECT p.unit_id, q.category, {HAV} AS km FROM units p, amenities q)
SELECT u.unit_id, round({haversine_sql('u.lat', 'u.lon', '6.9333', '79.8433', fv.FEATURE_RADIUS_KM)}, 6) AS distance_from_centre,
  round(min(km) FILTER (category = 'Brand#1'), 6) AS min_dist_1, round(min(km) FILTER (category = 'Brand#2'), 6) AS min_dist_2,
  count(*) FILTER (category = 'Brand#1' AND km <= 2.0) AS count_1, count(*) FILTER (category = 'Brand#2' AND km <= 5.0) AS count_2
FROM units u JOIN d ON u.unit_id = d.unit_id GROUP BY u.unit_id, u.lat, u.lon""")
def _(t):
    out = sp.proximity_features(t.units, "unit_id", as_targets(t.amenities, "category"), "category", ["Brand#1", "Brand#2"], 2.0, {"Brand#2": 5.0})
    return out.select("unit_id", r("distance_from_centre"), *[r(F.col(f"`min_dist_Brand#{i}`")).alias(f"min_dist_{i}") for i in (1, 2)],
                      *[F.col(f"`count_Brand#{i}`").alias(f"count_{i}") for i in (1, 2)])


@query("D20_features_fanned_out", f"""
WITH d AS (SELECT p.unit_id, count(*) FILTER ({HAV} <= 2.0) AS n, min({HAV}) AS km FROM units p, amenities q WHERE q.category = 'Brand#3' GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, division, n AS count_3, round(km, 6) AS min_dist_3 FROM listings JOIN d ON division = unit_id""")
def _(t):
    out = sp.proximity_features(t.units, "unit_id", as_targets(t.amenities, "category"), "category", ["Brand#3"], 2.0, centre=None)
    per = out.select(F.col("unit_id").alias("division"), F.col("`count_Brand#3`").alias("count_3"), r(F.col("`min_dist_Brand#3`")).alias("min_dist_3"))
    return t.listings.join(per, "division").select("l_orderkey", "l_linenumber", "l_partkey", "division", "count_3", "min_dist_3")


INSIDE = "p.lat >= b.y0 AND p.lat < b.y1 AND p.lon >= b.x0 AND p.lon < b.x1"


@query("D21_point_in_polygon", f"SELECT p.point_id, min(b.poly_id) AS poly_id FROM points p LEFT JOIN boxes b ON {INSIDE} GROUP BY 1")
def _(t):
    found = sp.point_in_polygon(t.points, t.boxes, "poly_id", ["poly_id"])
    return sp.attach_by_coordinate(t.points, found).select("point_id", "poly_id")


@query("D21_point_in_triangle", """
SELECT p.point_id, min(b.poly_id) AS poly_id FROM points p LEFT JOIN boxes b ON p.lat >= b.y0 AND p.lat < b.y1 AND p.lon >= b.x0 AND p.lon < (b.x1 - b.x0) * (p.lat - b.y1) / (b.y0 - b.y1) + b.x0 GROUP BY 1""")
def _(t):
    found = sp.point_in_polygon(t.points, t.triangles, "poly_id", ["poly_id"])
    return sp.attach_by_coordinate(t.points, found).select("point_id", "poly_id")


def centred(t):
    return t.boxes.withColumn("c_lat", (F.col("y0") + F.col("y1")) / 2).withColumn("c_lon", (F.col("x0") + F.col("x1")) / 2)


@query("D22_locate", f"""
WITH h AS (SELECT p.point_id, min(b.poly_id) FILTER (modelled) AS m, min(b.poly_id) FILTER (NOT modelled) AS o FROM points p LEFT JOIN boxes b ON {INSIDE} GROUP BY 1),
c AS (SELECT poly_id, address, (y0 + y1) / 2 AS lat, (x0 + x1) / 2 AS lon FROM boxes WHERE modelled),
n AS (SELECT p.point_id, q.address, {haversine_sql('p.lat', 'p.lon', 'q.lat', 'q.lon', fv.SERVING_RADIUS_M / 1000)} AS km, row_number() OVER (PARTITION BY p.point_id ORDER BY {haversine_sql('p.lat', 'p.lon', 'q.lat', 'q.lon', fv.SERVING_RADIUS_M / 1000)}, q.poly_id) AS rn FROM points p, c q)
SELECT h.point_id, a.address AS division, coalesce(a.address, b.address) AS gn_address, CASE WHEN m IS NOT NULL THEN 'polygon' ELSE 'outside' END AS match, m IS NOT NULL AS known,
  CASE WHEN m IS NULL THEN n.address END AS nearest_division, CASE WHEN m IS NULL THEN round(km, 2) ELSE 0 END AS distance_km
FROM h JOIN n ON h.point_id = n.point_id AND rn = 1 LEFT JOIN boxes a ON m = a.poly_id LEFT JOIN boxes b ON o = b.poly_id""")
def _(t):
    out = sp.locate(t.points, centred(t), "poly_id")
    return out.select("point_id", "division", "gn_address", "match", "known", "nearest_division", "distance_km")


CORNERS = """v AS (SELECT poly_id, x0 AS lon, y0 AS lat FROM boxes UNION ALL SELECT poly_id, x1, y0 FROM boxes UNION ALL SELECT poly_id, x1, y1 FROM boxes UNION ALL SELECT poly_id, x0, y1 FROM boxes)"""


@query("D23_nearest_vertex_km", f"WITH {CORNERS} SELECT point_id, round(min({HAV}), 6) AS km FROM points p, v q GROUP BY 1")
def _(t):
    return sp.nearest_vertex_km(t.points, t.boxes, "poly_id").select("point_id", r("km"))


@query("D24_within_buffer_units", f"""
WITH {CORNERS} SELECT DISTINCT p.poly_id FROM v p JOIN v q ON q.poly_id IN (0, 7) AND {HAV} <= 9.0""")
def _(t):
    return sp.within_buffer_units(t.boxes, "poly_id", t.boxes.filter("poly_id IN (0, 7)"), "poly_id", 9.0).select("poly_id")


HITS = f"""hits AS (SELECT l_suppkey AS unit, 'cat' || (l_suppkey % 3) AS category, CAST(l_linenumber % 4 AS INT) AS tier, CASE l_partkey % 5 WHEN 0 THEN 'highway' WHEN 1 THEN 'amenity' WHEN 2 THEN 'building' WHEN 3 THEN 'railway' ELSE 'place' END AS class,
    CAST(6.70 AS DOUBLE) + (l_partkey * 37 % 350) / CAST(1000 AS DOUBLE) AS lat, CAST(79.30 AS DOUBLE) + (l_partkey * 91 % 950) / CAST(1000 AS DOUBLE) AS lon,
    CAST(6.70 AS DOUBLE) + (l_suppkey * 37 % 350) / CAST(1000 AS DOUBLE) AS alat, CAST(79.80 AS DOUBLE) + (l_suppkey * 91 % 450) / CAST(1000 AS DOUBLE) AS alon FROM lineitem),
j AS (SELECT *, {haversine_sql('alat', 'alon', 'lat', 'lon', 6371.0)} AS km FROM hits),
k AS (SELECT *, CASE WHEN class NOT IN ('place', 'amenity', 'building') THEN 'class' WHEN NOT (lat BETWEEN 5.70 AND 9.95 AND lon BETWEEN 79.40 AND 82.00) THEN 'outside box' WHEN tier <> 1 AND km > (CASE WHEN category = 'cat0' THEN 3.0 ELSE 2.0 END) THEN 'too far' END AS reason FROM j)"""


def hits(t):
    li = t.lineitem
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    cls = F.element_at(F.array(*[F.lit(c) for c in ("highway", "amenity", "building", "railway", "place")]), (part % 5 + 1).cast("int"))
    return li.select(
        supp.alias("unit"), F.concat(F.lit("cat"), (supp % 3).cast("string")).alias("category"), (F.col("l_linenumber") % 4).alias("tier"), cls.alias("class"),
        (6.70 + (part * 37 % 350) / 1000.0).alias("lat"), (79.30 + (part * 91 % 950) / 1000.0).alias("lon"),
        (6.70 + (supp * 37 % 350) / 1000.0).alias("anchor_lat"), (79.80 + (supp * 91 % 450) / 1000.0).alias("anchor_lon"))


@query("D25_geocode_adjudicate", f"""
WITH {HITS}, b AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY tier, km, lat, lon) AS rn FROM k WHERE reason IS NULL)
SELECT u.unit, tier, round(km, 6) AS km, round(lat, 6) AS lat, round(lon, 6) AS lon, CASE WHEN tier IS NULL THEN 'failed' ELSE 'ok' END AS status
FROM (SELECT DISTINCT unit FROM hits) u LEFT JOIN b ON u.unit = b.unit AND rn = 1""")
def _(t):
    chosen, _rejected = sp.geocode_adjudicate(hits(t), "unit", ["place", "amenity", "building"], {"cat0": 3.0})
    return chosen.select("unit", "tier", r("km"), r("lat"), r("lon"), "status")


@query("D25_rejected_hits", f"WITH {HITS} SELECT unit, reason, count(*) AS n, round(min(km), 6) AS min_km FROM k WHERE reason IS NOT NULL GROUP BY 1, 2")
def _(t):
    _chosen, rejected = sp.geocode_adjudicate(hits(t), "unit", ["place", "amenity", "building"], {"cat0": 3.0})
    return rejected.select("unit", "reason", "n", r("min_km"))


PINS = f"""pins AS (SELECT p_partkey AS id, p_name AS name, CAST(6.70 AS DOUBLE) + (p_partkey * 37 % 350) / CAST(1000 AS DOUBLE) AS lat, CAST(79.80 AS DOUBLE) + (p_partkey * 91 % 450) / CAST(1000 AS DOUBLE) AS lon FROM part)"""
HAV_PIN = haversine_sql("p.lat", "p.lon", "q.lat", "q.lon", fv.MATCH_RADIUS_KM)


def pins(t):
    return t.amenities.select(F.col("amenity_id").alias("id"), "name", "lat", "lon")


@query("D26_duplicate_pin_audit", f"""
WITH {PINS}, o AS (SELECT p.id, min(q.id) AS owner FROM pins p JOIN pins q ON abs(p.lat - q.lat) < 0.01 AND {HAV_PIN} <= 0.6 GROUP BY 1)
SELECT p.id, CASE WHEN owner < p.id THEN owner END AS owner_order, CASE WHEN owner >= p.id THEN 'free' WHEN list_has_any(string_split(p.name, ' '), string_split(q.name, ' ')) THEN 'shared' ELSE 'blocked' END AS verdict
FROM pins p JOIN o ON p.id = o.id JOIN pins q ON o.owner = q.id""")
def _(t):
    return sp.duplicate_pin_audit(pins(t), "id", "name", 600.0).select("id", "owner_order", "verdict")


HAV_LIVE = haversine_sql("p.lat", "p.lon", "x.lat", "x.lon", fv.MATCH_RADIUS_KM)


# the walk in order itself, with the pins claimed so far
@query("D26_claim_pins", f"""
WITH RECURSIVE {PINS}, o AS (SELECT *, row_number() OVER (ORDER BY id) AS rn FROM pins),
w AS (SELECT CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS verdict, CAST([] AS STRUCT(name VARCHAR, lat DOUBLE, lon DOUBLE)[]) AS live
  UNION ALL SELECT rn, id, verdict, CASE WHEN verdict = 'blocked' THEN live ELSE list_append(live, struct_pack(name := name, lat := lat, lon := lon)) END
  FROM (SELECT *, CASE WHEN owner IS NULL THEN 'free' WHEN list_has_any(string_split(name, ' '), string_split(owner.name, ' ')) THEN 'shared' ELSE 'blocked' END AS verdict
    FROM (SELECT p.rn, p.id, p.name, p.lat, p.lon, w.live, [x FOR x IN w.live IF abs(p.lat - x.lat) < 0.01 AND {HAV_LIVE} <= 0.6][1] AS owner FROM w JOIN o p ON p.rn = w.rn + 1)))
SELECT id, verdict FROM w WHERE rn > 0""")
def _(t):
    return sp.claim_pins(pins(t), "id", "name", 600.0).select("id", "verdict")


@query("D27_anchor_collapse", """
WITH a AS (SELECT round(lat, 2) AS lat, round(lon, 2) AS lon, name FROM points)
SELECT lat, lon, count(DISTINCT name) AS n_labels, count(*) AS n, min(name) AS first_label FROM a GROUP BY 1, 2 HAVING count(DISTINCT name) > 1""")
def _(t):
    coarse = t.points.select(r("lat", 2), r("lon", 2), "name")
    return sp.anchor_collapse(coarse, "lat", "lon", "name", 2)


@query("D28_independent_distance_check", f"""
WITH d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderkey % 50 AS DOUBLE) END AS stated, {haversine_sql('p.lat', 'p.lon', '6.9333', '79.8433', fv.FEATURE_RADIUS_KM)} AS km FROM orders JOIN points p ON o_custkey = point_id)
SELECT o_orderkey, round(km, 6) AS km, coalesce(abs(km - stated) <= 5, true) AS agrees, CASE WHEN km > stated + 5 THEN 'overshoot' WHEN km < stated * 0.5 THEN 'too short' ELSE 'ok' END AS one_sided FROM d""")
def _(t):
    stated = F.when(F.col("o_orderkey") % 11 != 0, (F.col("o_orderkey") % 50).cast("double"))
    joined = t.orders.join(t.points, F.col("o_custkey") == F.col("point_id")).withColumn("stated", stated)
    out = sp.distance_check(joined, geo.distance_to_point(F.col("lat"), F.col("lon")), F.col("stated"), 5.0, 0.5)
    return out.select("o_orderkey", r("km"), "agrees", "one_sided")


MARKS = {"north": {"first": ["the", "is"], "second": ["ou"]}, "south": {"third": ["der", "die"], "fourth": ["la"]}}


def occurrences(words):
    return " + ".join(f"(length(x) - length(replace(x, '{w}', ''))) // {len(w)}" for w in words)


@query("D29_landmark_vote", f"""
WITH d AS (SELECT lang, source, lower(text) AS x FROM documents), c AS (SELECT lang, source, CAST(sum({occurrences(['the', 'is'])}) AS BIGINT) AS a, CAST(sum({occurrences(['ou'])}) AS BIGINT) AS b, CAST(sum({occurrences(['der', 'die'])}) AS BIGINT) AS c, CAST(sum({occurrences(['la'])}) AS BIGINT) AS e FROM d GROUP BY 1, 2)
SELECT lang, source, a + b AS mentions_north, c + e AS mentions_south, CASE WHEN (a + b) / CAST(a + b + c + e AS DOUBLE) >= 0.6 THEN 'north' WHEN (c + e) / CAST(a + b + c + e AS DOUBLE) >= 0.6 THEN 'south' ELSE 'no majority' END AS majority,
  CASE WHEN a >= greatest(b, c, e) THEN 'first' WHEN b >= greatest(c, e) THEN 'second' WHEN c >= e THEN 'third' ELSE 'fourth' END AS top_landmark FROM c""")
def _(t):
    return sp.landmark_vote(t.documents, ["lang", "source"], "text", MARKS)


CLAIMS = [(6.84, 80.00, 8.0), (6.80, 80.04, 7.0), (6.83, 79.96, 10.0)]


@query("D30_triangulate", "SELECT unit_id, round((" + " + ".join(f"abs({haversine_sql('lat', 'lon', str(a), str(o), 6371.0)} - {k})" for a, o, k in CLAIMS) + ") / 3, 6) AS mean_error_km FROM units")
def _(t):
    return sp.triangulate(t.units, "lat", "lon", CLAIMS).select("unit_id", r("mean_error_km"))


@query("D31_areal_share", """
SELECT poly_id, CASE WHEN poly_id % 3 <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS covered,
  CASE WHEN poly_id % 3 <> 0 AND poly_id % 2 = 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS flooded_share FROM boxes""")
def _(t):
    out = sp.areal_share(t.boxes, "poly_id", t.boxes.filter("poly_id % 3 <> 0"), t.triangles.filter("poly_id % 2 = 0"))
    return out.select("poly_id", r("covered"), r("flooded_share"))


# Every customer's own rectangle against the boxes; in the coordinates of a box its triangle is u + v <= 1.
@query("D31_areal_share_around_points", """
WITH u AS (SELECT point_id, lon - 0.0041 * (1 + point_id % 5) AS a, lon + 0.0307 AS b, lat - 0.0193 AS c, lat + 0.0029 * (1 + point_id % 7) AS d FROM points),
j AS (SELECT point_id, poly_id, (b - a) * (d - c) AS area, (x1 - x0) * (y1 - y0) AS box,
    least(greatest((a - x0) / (x1 - x0), 0), 1) AS u0, least(greatest((b - x0) / (x1 - x0), 0), 1) AS u1, least(greatest((c - y0) / (y1 - y0), 0), 1) AS v0, least(greatest((d - y0) / (y1 - y0), 0), 1) AS v1
  FROM u JOIN boxes ON a < x1 AND b > x0 AND c < y1 AND d > y0),
k AS (SELECT *, box * (u1 - u0) * (v1 - v0) AS both_area, box * ((u1 - u0) * (v1 - v0) - (greatest(u1 + v1 - 1, 0) ** 2 - greatest(u0 + v1 - 1, 0) ** 2 - greatest(u1 + v0 - 1, 0) ** 2 + greatest(u0 + v0 - 1, 0) ** 2) / 2) AS under FROM j),
s AS (SELECT point_id, coalesce(sum(both_area) FILTER (poly_id % 3 <> 0), 0) / any_value(area) AS covered, coalesce(sum(under) FILTER (poly_id % 2 = 0), 0) / any_value(area) AS flooded FROM k GROUP BY 1)
SELECT u.point_id, round(coalesce(covered, 0), 6) AS covered, round(CASE WHEN covered > 1e-9 THEN flooded ELSE 0 END, 6) AS flooded_share FROM u LEFT JOIN s USING (point_id)""")
def _(t):
    k, lon, lat = F.col("point_id"), F.col("lon"), F.col("lat")
    x0, x1, y0, y1 = lon - 0.0041 * (1 + k % 5), lon + 0.0307, lat - 0.0193, lat + 0.0029 * (1 + k % 7)
    corners = [F.struct(x.alias("lon"), y.alias("lat")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]
    units = t.points.select("point_id", F.array(F.array(*corners)).alias("rings"))
    out = sp.areal_share(units, "point_id", t.boxes.filter("poly_id % 3 <> 0"), t.triangles.filter("poly_id % 2 = 0"))
    return out.select("point_id", r("covered"), r("flooded_share"))
