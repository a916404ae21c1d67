"""Usage analytics and their streaming forms."""

from pyspark.sql import functions as F

from parcelytics.catalog.registry import query
from parcelytics.catalog.registry import rounded as r
from parcelytics.catalog.queries_spatial import as_targets
from parcelytics.catalog.queries_text import scratch
from parcelytics.catalog.views import haversine_sql, with_point
from parcelytics import fixed_values as fv
from parcelytics.operators import spatial as sp
from parcelytics.operators import usage as us
from parcelytics.streaming import jobs

QUOTA = """SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW) AS used FROM events"""


@query("U1_rolling_quota", f"""
WITH q AS ({QUOTA}) SELECT event_id, user_id, used, greatest(60 - used, 0) AS remaining, used >= 60 AS blocked FROM q""")
def _(t):
    return us.rolling_quota(t.events, "user_id", "event_id", "ts", 7, 60).select("event_id", "user_id", "used", "remaining", "blocked")


# each user's requests in order, with the accepted times so far
@query("U1_replay_quota", """
WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(CAST(ts AS TIMESTAMP)) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
w AS (SELECT user_id, event_id, rn, [us] AS taken, true AS accepted FROM o WHERE rn = 1
  UNION ALL SELECT o.user_id, o.event_id, o.rn,
    CASE WHEN len([x FOR x IN taken IF x >= o.us - 604800000000]) < 40 THEN list_append([x FOR x IN taken IF x >= o.us - 604800000000], o.us) ELSE taken END,
    len([x FOR x IN taken IF x >= o.us - 604800000000]) < 40
  FROM w JOIN o ON o.user_id = w.user_id AND o.rn = w.rn + 1)
SELECT user_id, event_id, accepted FROM w""")
def _(t):
    return us.replay_quota(t.events, "user_id", "event_id", "ts", 7, 40)


STATUS = {"view": "active", "click": "trialing", "error": "past_due", "signup": "incomplete", "purchase": "deleted"}


def subscription_events(t):
    status = F.try_element_at(F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair]), F.col("event_type"))
    return t.events.select("user_id", F.when(F.col("event_type") == "purchase", "deleted").otherwise("updated").alias("kind"), status.alias("status"), "ts", "event_id")


LATEST = """l AS (SELECT user_id, CASE arg_max(event_type, (ts, event_id)) WHEN 'view' THEN 'active' WHEN 'click' THEN 'trialing' WHEN 'error' THEN 'past_due' WHEN 'signup' THEN 'incomplete' ELSE 'canceled' END AS status FROM events GROUP BY 1)
SELECT user_id, status, CASE WHEN status IN ('active', 'trialing') THEN 'pro' ELSE 'free' END AS plan, status IN ('active', 'trialing') AS is_pro FROM l"""


@query("U2_subscription_state", f"WITH {LATEST}")
def _(t):
    return us.subscription_state(subscription_events(t), "user_id", "kind", "status", [F.col("ts"), F.col("event_id")])


@query("U3_dashboard", """
WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 100)
SELECT user_id, count(*) AS count, round(median(value), 4) AS median_price, round(sum(value * 12), 3) AS total_value, count(DISTINCT event_type) AS division_count FROM l GROUP BY 1""")
def _(t):
    history = t.events.withColumn("total", F.col("value") * 12)
    out = us.dashboard(history, "user_id", "ts", "event_id", "value", "total", "event_type")
    return out.select("user_id", "count", r("median_price", 4), r("total_value", 3), "division_count")


@query("U4_monthly_activity", """
WITH m AS (SELECT unnest(generate_series(TIMESTAMP '1998-02-01', TIMESTAMP '1998-07-01', INTERVAL 1 MONTH)) AS mo), k AS (SELECT DISTINCT o_custkey FROM orders), c AS (SELECT o_custkey, date_trunc('month', o_orderdate) AS mo, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT k.o_custkey, strftime(m.mo, '%b %Y') AS label, strftime(m.mo, '%Y-%m-%d') AS month, coalesce(n, 0) AS n FROM k CROSS JOIN m LEFT JOIN c ON c.o_custkey = k.o_custkey AND CAST(c.mo AS DATE) = CAST(m.mo AS DATE)""")
def _(t):
    out = us.monthly_activity(t.orders, "o_orderdate", "1998-07-20", 6, ["o_custkey"])
    return out.select("o_custkey", "label", F.date_format("month", "yyyy-MM-dd").alias("month"), "n")


@query("U5_fixed_level_counts", """
WITH l AS (SELECT CASE event_type WHEN 'error' THEN 'High' WHEN 'click' THEN 'Medium' ELSE 'No official record' END AS level FROM events)
SELECT CAST(p AS INT) AS position, v.level, count(l.level) AS n FROM (SELECT unnest(['High', 'Medium', 'Low', 'No official record']) AS level, unnest([0, 1, 2, 3]) AS p) v LEFT JOIN l ON l.level = v.level GROUP BY 1, 2""")
def _(t):
    level = F.when(F.col("event_type") == "error", "High").when(F.col("event_type") == "click", "Medium").otherwise("other")
    return us.fixed_level_counts(t.events, level, fv.FLOOD_LEVELS)


HAV_M = haversine_sql("p.lat", "p.lon", "q.lat", "q.lon", fv.SERVING_RADIUS_M / 1000)


@query("U6_nearby", f"""
WITH pts AS (SELECT DISTINCT lat, lon FROM points), n AS (SELECT p.lat, p.lon, q.category, q.amenity_id, CASE WHEN q.amenity_id % 6 = 0 THEN 'Place' ELSE q.name END AS label, CAST(round({HAV_M} * 1000) AS BIGINT) AS distance_m FROM pts p JOIN amenities q ON abs(p.lat - q.lat) < 0.02 AND {HAV_M} <= 1.5),
k AS (SELECT *, row_number() OVER (PARTITION BY lat, lon, category ORDER BY distance_m, amenity_id) AS rn FROM n)
SELECT round(lat, 4) AS lat, round(lon, 4) AS lon, category, CAST(rn AS INT) AS rank, label, distance_m, amenity_id FROM k WHERE rn <= 8""")
def _(t):
    label = F.when(F.col("amenity_id") % 6 == 0, "Place").otherwise(F.col("name"))
    out = sp.nearby(t.points, as_targets(t.amenities, "amenity_id", "name", "category"), "category", label, tie=["amenity_id"])
    return out.select(r("lat", 4), r("lon", 4), "category", "rank", "label", "distance_m", "amenity_id")


def bucketed(t):
    asked = with_point(t.events.select("event_id", "ts", (F.col("user_id") * 13 + F.col("event_id") % 5).alias("k")), "k")
    cache = with_point(t.events.filter("event_type = 'purchase'").select("event_id", "ts", (F.col("user_id") * 13 + F.col("event_id") % 5).alias("k")), "k").select(
        F.round(F.col("lat") * 1000, 0).cast("long").alias("lat_bucket"), F.round(F.col("lon") * 1000, 0).cast("long").alias("lon_bucket"),
        F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("payload"), (F.col("ts") - F.expr("interval 20 days")).alias("fetched_at"))
    fetched = asked.filter("k % 3 = 0").select(F.round(F.col("lat") * 1000, 0).cast("long").alias("lat_bucket"), F.round(F.col("lon") * 1000, 0).cast("long").alias("lon_bucket")).distinct().withColumn("payload", F.lit("new"))
    return asked, cache, fetched


@query("U7_cache_bucket", """
WITH a AS (SELECT event_id, ts, event_type, user_id * 13 + event_id % 5 AS k FROM events), b AS (SELECT *, 6700 + k * 37 % 350 AS la, 79800 + k * 91 % 450 AS lo FROM a),
c AS (SELECT la, lo, arg_max('c' || event_id, (ts, 'c' || event_id)) AS payload, max(ts) - INTERVAL 20 DAYS AS fetched_at FROM b WHERE event_type = 'purchase' GROUP BY 1, 2), n AS (SELECT DISTINCT la, lo FROM b WHERE k % 3 = 0),
j AS (SELECT b.event_id, coalesce(fetched_at > ts - INTERVAL 30 DAYS, false) AS fresh, c.payload AS old, n.la IS NOT NULL AS has_new FROM b LEFT JOIN c ON b.la = c.la AND b.lo = c.lo LEFT JOIN n ON b.la = n.la AND b.lo = n.lo)
SELECT event_id, CASE WHEN fresh THEN 'cache' WHEN has_new THEN 'fetched' WHEN old IS NOT NULL THEN 'stale' ELSE 'none' END AS source, CASE WHEN fresh THEN old WHEN has_new THEN 'new' ELSE old END AS payload FROM j""")
def _(t):
    asked, cache, fetched = bucketed(t)
    return us.cached_lookup(asked, cache, fetched, "ts").select("event_id", "source", "payload")


@query("U8_estimate_report", """
WITH h AS (SELECT event_id, user_id % 40 AS division, user_id % 40 < 30 AS known_division, CASE event_type WHEN 'click' THEN 'high' WHEN 'view' THEN 'low' END AS confidence FROM events),
rec AS (SELECT n_nationkey AS division, CASE n_nationkey % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Low' END AS indication, CASE WHEN n_nationkey % 4 <> 0 THEN round((n_nationkey % 7) / CAST(40 AS DOUBLE) * 100, 1) END AS pct, CASE n_nationkey % 2 WHEN 0 THEN '2016, 2018' END AS yrs FROM nation)
SELECT event_id, h.division, known_division, confidence, CASE WHEN known_division THEN 'Known division' ELSE 'City-wide average (unknown division)' END AS basis, coalesce(upper(left(confidence, 1)) || substring(confidence, 2), 'N/A') AS grade,
  coalesce(indication, 'No official record') AS indication, CASE WHEN pct IS NULL THEN 'outside the mapped area' WHEN pct > 0 THEN CAST(CAST(round_even(pct, 0) AS INT) AS VARCHAR) || '% inside the flood extent' ELSE 'mapped - not flooded' END AS map_a,
  coalesce(yrs, 'none') AS records, CASE WHEN rec.division IS NOT NULL THEN CAST(rec.division AS DOUBLE) / 10 END AS hand_m FROM h LEFT JOIN rec ON h.division = rec.division""")
def _(t):
    k = F.col("n_nationkey")
    history = t.events.select("event_id", (F.col("user_id") % 40).alias("division"), (F.col("user_id") % 40 < 30).alias("known_division"),
                              F.when(F.col("event_type") == "click", "high").when(F.col("event_type") == "view", "low").alias("confidence"))
    records = t.nation.select(k.cast("long").alias("division"), F.when(k % 3 == 0, "High").when(k % 3 == 1, "Medium").otherwise("Low").alias("indication"),
                              ((k % 7) / 40).alias("flooded_share_a"), F.when(k % 4 != 0, 0.9).otherwise(0.3).alias("covered_a"),
                              F.when(k % 2 == 0, "2016 2018").otherwise("").alias("years_text"))
    profiles = t.nation.select(k.cast("long").alias("division"), (k / 10).alias("hand_m"))
    return us.estimate_report(history, records, profiles, "division", ["a"], ["hand_m"])


# --------------------------------------------------------------------------- streaming forms
@query("U1_stream_window_counts", """
SELECT user_id, strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1, 2""")
def _(t):
    out = jobs.run_window_counts(t.spark, f"{t.folder}/events.parquet", t.events.schema, scratch(t, "stream"), "user_id", "ts", "1 day")
    return out.select("user_id", F.date_format("window_start", "yyyy-MM-dd").alias("day"), "n")


@query("U1_stream_quota", f"""
WITH q AS ({QUOTA}) SELECT event_id, user_id, used FROM q""")
def _(t):
    return jobs.run_quota(t.spark, f"{t.folder}/events.parquet", t.events.schema, scratch(t, "stream"), "user_id", "event_id", "ts", 7)


@query("U2_stream_subscription_state", f"WITH {LATEST}")
def _(t):
    latest = jobs.run_latest_per_key(t.spark, f"{t.folder}/events.parquet", t.events.schema, scratch(t, "stream"), ["user_id"], ["ts", "event_id"])
    status = F.try_element_at(F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair]), F.col("event_type"))
    events = latest.select("user_id", F.when(F.col("event_type") == "purchase", "deleted").otherwise("updated").alias("kind"), status.alias("status"), "ts", "event_id")
    return us.subscription_state(events, "user_id", "kind", "status", [F.col("ts"), F.col("event_id")])


@query("U7_stream_cache_table", """
SELECT k, arg_max(event_id, (ts, event_id)) AS event_id FROM (SELECT user_id * 13 + event_id % 5 AS k, ts, event_id FROM events) GROUP BY 1""")
def _(t):
    latest = jobs.run_latest_per_key(t.spark, f"{t.folder}/events.parquet", t.events.schema, scratch(t, "stream"), ["k"], ["ts", "event_id"],
                                     lambda df: df.withColumn("k", F.col("user_id") * 13 + F.col("event_id") % 5))
    return latest.select("k", "event_id")
