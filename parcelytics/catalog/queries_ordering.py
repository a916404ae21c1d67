"""Ranks, limits, upserts, key sets and expectations."""

from pyspark.sql import functions as F

from parcelytics import fixed_values as fv
from parcelytics.catalog.registry import query
from parcelytics.catalog.registry import rounded as r
from parcelytics.operators import aggregates, expect, ordering, rules
from parcelytics.plans.scale import top_k_per_group, with_value_rank

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
KEYS = ", ".join(KEY)
TOTAL = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "total_price", "discount", "tax"]
TOTALS = ", ".join(TOTAL)


@query("G1_dedup_keep_earliest", """
WITH e AS (SELECT *, row_number() OVER (PARTITION BY division, land_type, posted IS NULL, CASE WHEN l_orderkey % 5 <> 0 THEN land_size END
  ORDER BY posted ASC NULLS LAST, l_orderkey, l_linenumber, l_partkey, total_price, discount, tax) AS rn FROM listings)
SELECT rn = 1 AS kept, count(*) AS n, round(sum(total_price), 2) AS total, count(DISTINCT division) AS divisions FROM e GROUP BY 1""")
def _(t):
    df = t.listings.withColumn("size_key", F.when(F.col("l_orderkey") % 5 != 0, F.col("land_size"))).withColumn("undated", F.col("posted").isNull())
    order = [F.col(c) for c in ["l_orderkey", "l_linenumber", "l_partkey", "total_price", "discount", "tax"]]
    df = df.select("division", "land_type", "undated", "size_key", "posted", "l_orderkey", "l_linenumber", "l_partkey", "total_price", "discount", "tax")
    keep, removed = rules.dedup_keep_earliest(df, ["division", "land_type", "undated", "size_key"], "posted", order)
    both = keep.select(F.lit(True).alias("kept"), F.lit(1).alias("copies"), "total_price", "division").unionByName(
        removed.select(F.lit(False).alias("kept"), "copies", "total_price", "division"))
    return both.groupBy("kept").agg(F.sum("copies").alias("n"), r(F.sum(F.col("copies") * F.col("total_price")), 2).alias("total"),
                                    F.count_distinct("division").alias("divisions"))


@query("G1_dedup_documents", """
SELECT doc_id, lang, source, md5(text) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""")
def _(t):
    docs = t.documents.select("doc_id", "lang", "source", "text", F.lit(None).cast("timestamp").alias("posted"))
    keep, _removed = rules.dedup_keep_earliest(docs, ["text"], "posted", [F.col("doc_id")])
    return keep.select("doc_id", "lang", "source", F.md5(F.encode("text", "UTF-8")).alias("digest"))


@query("G2_frequency_rank", """
WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
SELECT o_custkey, n, CAST(row_number() OVER (ORDER BY n DESC, o_custkey) AS BIGINT) AS frequency_rank FROM c""")
def _(t):
    out = aggregates.frequency_rank(aggregates.keyed_counts(t.orders, "o_custkey"), "o_custkey", "n")
    return out.withColumn("frequency_rank", F.col("frequency_rank").cast("long"))


@query("G3_rank", f"""
SELECT {TOTALS}, CAST(rank() OVER (PARTITION BY division ORDER BY land_size DESC) AS BIGINT) AS rank_min,
  rank() OVER (PARTITION BY division ORDER BY land_size DESC) + (count(*) OVER (PARTITION BY division, land_size) - 1) / CAST(2 AS DOUBLE) AS rank_avg FROM listings""")
def _(t):
    return with_value_rank(t.listings, ["division"], "land_size", True).select(*TOTAL, F.col("rank_min").cast("long"), "rank_avg")


@query("G4_top_and_bottom_k", f"""
WITH a AS (SELECT row_number() OVER (ORDER BY unit_price DESC, {TOTALS}) AS p, {KEYS}, unit_price FROM listings),
b AS (SELECT row_number() OVER (ORDER BY unit_price, {TOTALS}) AS p, {KEYS}, unit_price FROM listings)
SELECT CAST(a.p AS INT) AS position, a.l_orderkey AS top_l_orderkey, round(a.unit_price, 4) AS top_price, b.l_orderkey AS bottom_l_orderkey, round(b.unit_price, 4) AS bottom_price
FROM a JOIN b ON a.p = b.p WHERE a.p <= 15""")
def _(t):
    tail = [F.col(c) for c in TOTAL]
    out = ordering.ends_side_by_side(t.listings, F.struct(-F.col("unit_price"), *tail), F.struct(F.col("unit_price"), *tail), ["l_orderkey", "unit_price"], 15)
    return out.select("position", "top_l_orderkey", r(F.col("top_unit_price"), 4).alias("top_price"), "bottom_l_orderkey", r(F.col("bottom_unit_price"), 4).alias("bottom_price"))


@query("G5_top_k_per_group", f"""
SELECT division, {KEYS}, round(unit_price, 4) AS unit_price, CAST(rn AS INT) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY division ORDER BY unit_price DESC, {TOTALS}) AS rn FROM listings) WHERE rn <= 8""")
def _(t):
    out = top_k_per_group(t.listings, ["division"], [F.col("unit_price").desc(), *[F.col(c) for c in TOTAL]], 8)
    return out.select("division", *KEY, r("unit_price", 4), "rn")


@query("G6_top_k_plus_other", """
WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY n DESC, p_brand) AS rn FROM c)
SELECT CASE WHEN rn <= 4 THEN p_brand ELSE 'Other' END AS p_brand, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY 1""")
def _(t):
    return ordering.top_k_plus_other(t.part, "p_brand", 4)


@query("G7_two_stage_top", """
WITH s AS (SELECT o_custkey, count(*) AS n, avg(o_totalprice) AS mean FROM orders GROUP BY 1),
k AS (SELECT * FROM s ORDER BY n DESC, o_custkey LIMIT 8)
SELECT o_custkey, n, round(mean, 4) AS mean, CAST(row_number() OVER (ORDER BY mean DESC, o_custkey) AS INT) AS position FROM k""")
def _(t):
    return ordering.two_stage_top(t.orders, "o_custkey", "o_totalprice", 8).select("o_custkey", "n", r("mean", 4), "position")


@query("G8_keep_last_per_key", """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'second' WHEN c_custkey % 2 = 0 THEN 'first' ELSE 'base' END AS origin FROM customer""")
def _(t):
    k = t.customer.select("c_custkey")
    batch = lambda label: k.withColumn("origin", F.lit(label))
    return ordering.upsert_last([batch("base"), batch("first").filter("c_custkey % 2 = 0"), batch("second").filter("c_custkey % 3 = 0")], ["c_custkey"])


@query("G9_keep_first_unique", f"""
SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1""")
def _(t):
    df = t.lineitem.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    return ordering.keep_first_unique(df, ["l_partkey", "l_suppkey"], [F.col("l_orderkey"), F.col("l_linenumber")])


@query("G10_union_by_name", """
WITH u AS (SELECT 0 AS src, point_id AS id, name, lat, lon FROM points UNION ALL SELECT 1, unit_id, name, lat, lon FROM units),
a AS (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY src, id) AS n1 FROM u),
b AS (SELECT *, row_number() OVER (PARTITION BY round(lat, 5), round(lon, 5) ORDER BY src, id) AS n2 FROM a WHERE n1 = 1)
SELECT src, id, name FROM b WHERE n2 = 1""")
def _(t):
    left = t.points.select(F.lit(0).alias("src"), F.col("point_id").alias("id"), "name", "lat", "lon", "nation")
    right = t.units.select(F.lit(1).alias("src"), F.col("unit_id").alias("id"), "name", "lat", "lon", "area")
    union = left.unionByName(right, allowMissingColumns=True)
    cleaned = rules.clean_points(union, "name", "lat", "lon", [F.col("src"), F.col("id")])
    return cleaned.filter("reason IS NULL").select("src", "id", "name")


@query("G11_set_reconcile", """
SELECT k AS l_partkey, CASE WHEN a AND b THEN 'both' WHEN a THEN 'left' ELSE 'right' END AS side FROM (
  SELECT coalesce(x.k, y.k) AS k, x.k IS NOT NULL AS a, y.k IS NOT NULL AS b FROM (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_discount > 0.08) x
  FULL JOIN (SELECT p_partkey AS k FROM part WHERE p_size > 10) y ON x.k = y.k)""")
def _(t):
    left = t.lineitem.filter("l_discount > 0.08").select("l_partkey")
    return ordering.set_reconcile(left, t.part.filter("p_size > 10").select(F.col("p_partkey").alias("l_partkey")), "l_partkey")


@query("G12_median_row_per_group", f"""
WITH g AS (SELECT division, min(discount + l_partkey * CAST(0.001 AS DOUBLE)) AS f, count(*) AS n FROM listings GROUP BY 1),
e AS (SELECT 'lowest' AS "end", division, n FROM (SELECT * FROM g ORDER BY f, division LIMIT 1) UNION ALL SELECT 'highest', division, n FROM (SELECT * FROM g ORDER BY f DESC, division DESC LIMIT 1)),
r AS (SELECT l.*, e."end", e.n, row_number() OVER (PARTITION BY e."end" ORDER BY unit_price, {TOTALS}) AS rn FROM listings l JOIN e ON l.division = e.division)
SELECT "end", division, {KEYS}, round(unit_price, 4) AS unit_price FROM r WHERE rn = (n - 1) // 2 + 1""")
def _(t):
    df = t.listings.withColumn("f", F.col("discount") + F.col("l_partkey") * 0.001)
    out = ordering.median_rows_at_extremes(df, "division", "f", [F.col("unit_price"), *[F.col(c) for c in TOTAL]])
    return out.select("end", "division", *KEY, r("unit_price", 4))


@query("G13_percentile_of", f"""
SELECT {TOTALS}, round(100 * cume_dist() OVER (ORDER BY abs(land_size - 25)), 6) AS pct FROM listings""")
def _(t):
    df = t.listings.withColumn("v", F.col("land_size") - 25)
    return ordering.percentile_of(df, "v", "pct").select(*TOTAL, r("pct"))


@query("G14_latest_n", """
SELECT user_id, event_id, CAST(rn AS INT) AS recency FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 100""")
def _(t):
    return ordering.latest_n(t.events, "user_id", "ts", "event_id", 100).select("user_id", "event_id", "recency")


@query("S1_expect_shape", """
SELECT 'shape' AS "check", count(DISTINCT o_custkey) > 0 AS ok, concat_ws(' ', 'rows', count(*), 'columns', 6, 'groups', count(DISTINCT o_custkey)) AS detail FROM orders""")
def _(t):
    return expect.expect_shape(t.orders, columns=6, group="o_custkey")


@query("S2_expect_unique", """
WITH d AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
SELECT 'unique l_orderkey,l_linenumber' AS "check", count(*) = 0 AS ok, concat_ws(' ', count(*), 'keys over', CAST(coalesce(sum(n), 0) AS BIGINT), 'rows') AS detail FROM d""")
def _(t):
    return expect.expect_unique(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("S3_expect_in_bbox_not_null_one_value", """
SELECT 'coordinates in box' AS "check", count(*) FILTER (NOT (lat BETWEEN 5.7 AND 7.0 AND lon BETWEEN 79.3 AND 82.1)) = 0 AS ok,
  concat_ws(' ', count(*) FILTER (NOT (lat BETWEEN 5.7 AND 7.0 AND lon BETWEEN 79.3 AND 82.1)), 'rows outside or missing') AS detail FROM points
UNION ALL SELECT 'not null posted,division', count(*) FILTER (posted IS NULL) = 0, concat_ws(' ', count(*) FILTER (posted IS NULL), 'missing values') FROM listings
UNION ALL SELECT 'one land_type per l_partkey', count(*) = 0, concat_ws(' ', count(*), 'keys with several values') FROM (SELECT l_partkey FROM listings GROUP BY 1 HAVING count(DISTINCT land_type) > 1)""")
def _(t):
    return (
        expect.expect_in_box(t.points, "lat", "lon", {"lat": (5.7, 7.0), "lon": (79.3, 82.1)})
        .unionByName(expect.expect_not_null(t.listings, ["posted", "division"]))
        .unionByName(expect.expect_one_value_per_key(t.listings, "l_partkey", "land_type"))
    )


@query("S4_expect_points_inside_box_with_margin", """
WITH s AS (SELECT round(least(min(lat) - 5.7, 10 - max(lat), min(lon) - 79.3, CAST(82.1 AS DOUBLE) - max(lon)), 4) AS slack FROM points)
SELECT 'points inside box with margin' AS "check", slack >= 0.15 AS ok, CAST(slack AS VARCHAR) AS detail FROM s""")
def _(t):
    return expect.expect_points_inside(t.points, "lat", "lon", fv.CLEAN_BOX)


@query("S5_expect_close", """
WITH s AS (SELECT max(greatest(abs(p.lat - q.lat), abs(p.lon - q.lon))) AS gap FROM points p JOIN (SELECT unit_id, lat + CASE WHEN unit_id % 3 = 0 THEN 0.0005 ELSE 0 END AS lat, lon FROM units) q ON p.point_id = q.unit_id)
SELECT 'close lat,lon' AS "check", gap <= 0.001 AS ok, CAST(round(gap, 6) AS VARCHAR) AS detail FROM s""")
def _(t):
    moved = t.units.select(F.col("unit_id").alias("point_id"), (F.col("lat") + F.when(F.col("unit_id") % 3 == 0, 0.0005).otherwise(0.0)).alias("lat"), "lon")
    return expect.expect_close(t.points, moved, "point_id", ["lat", "lon"], 0.001).withColumn("detail", F.expr("cast(cast(detail as decimal(10,4)) as string)"))


@query("S7_expect_dim_values", """
SELECT 'c_nationkey exists' AS "check", count(DISTINCT c_nationkey) = 0 AS ok, concat_ws(' ', count(DISTINCT c_nationkey), 'unknown names') AS detail
FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 4)""")
def _(t):
    dim = t.nation.filter("n_regionkey < 4").select(F.col("n_nationkey").alias("c_nationkey"))
    return expect.expect_dim_values(t.customer, dim, "c_nationkey")


@query("S8_coverage_report", """
SELECT CASE WHEN grouping(category) = 1 THEN 'TOTAL' ELSE category END AS category, count(*) FILTER (lat > 6.8) AS kept, count(*) FILTER (NOT lat > 6.8) AS failed,
  round(100 * count(*) FILTER (lat > 6.8) / CAST(count(*) AS DOUBLE), 6) AS kept_pct FROM amenities GROUP BY ROLLUP (category)""")
def _(t):
    return expect.coverage_report(t.amenities, "category", F.col("lat") > 6.8).withColumn("kept_pct", r("kept_pct"))
