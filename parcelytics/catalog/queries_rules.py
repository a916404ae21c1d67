"""Cleaning rules on the listing view, and the flagship profile."""

from pyspark.sql import functions as F

from parcelytics import fixed_values as fv
from parcelytics.catalog.registry import query
from parcelytics.catalog.registry import rounded as r
from parcelytics.functions import numeric, text
from parcelytics.operators import aggregates, rules
from parcelytics.plans.scale import attach_quantiles
from parcelytics.session import freeze

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
KEYS = ", ".join(KEY)


@query("flagship_division_profile", """
WITH band AS (SELECT quantile_cont(unit_price, 0.005) AS lo, quantile_cont(unit_price, 0.995) AS hi FROM listings),
a AS (SELECT l.* FROM listings l, band WHERE unit_price BETWEEN lo AND hi),
b AS (SELECT * FROM (SELECT *, avg(unit_price) OVER (PARTITION BY division) m, stddev_samp(unit_price) OVER (PARTITION BY division) s FROM a)
      WHERE s IS NULL OR abs(unit_price - m) <= 1.5 * s),
c AS (SELECT * FROM (SELECT * EXCLUDE (m, s), avg(land_size) OVER (PARTITION BY division) m, stddev_samp(land_size) OVER (PARTITION BY division) s FROM b)
      WHERE s IS NULL OR abs(land_size - m) <= 1.5 * s),
g AS (SELECT division, count(*) AS n, median(unit_price) AS med, quantile_cont(unit_price, 0.25) AS q1,
      quantile_cont(unit_price, 0.75) AS q3, min(unit_price) AS lo, max(unit_price) AS hi FROM c GROUP BY 1)
SELECT division, n, round(med, 4) AS median_price, round(q1, 4) AS q1, round(q3, 4) AS q3, round(q3 - q1, 4) AS iqr,
  round(lo, 4) AS min_price, round(hi, 4) AS max_price,
  CAST(row_number() OVER (ORDER BY n DESC, division) AS BIGINT) AS frequency_rank FROM g""")
def _(t):
    banded = rules.quantile_band(t.listings.select("division", "unit_price", "land_size"), "unit_price")
    trimmed = rules.trim_per_group(rules.trim_per_group(banded, "unit_price", "division"), "land_size", "division")
    # the profile reads its rows several times; without this the band and both trims would run again each time
    profile = aggregates.group_summary(freeze(trimmed), ["division"], "unit_price")
    ranked = aggregates.frequency_rank(profile, "division", "n")
    return ranked.select(
        "division", "n", r(F.col("median"), 4).alias("median_price"), r(F.col("q1"), 4).alias("q1"),
        r(F.col("q3"), 4).alias("q3"), r(F.col("iqr"), 4).alias("iqr"), r(F.col("min"), 4).alias("min_price"),
        r(F.col("max"), 4).alias("max_price"), F.col("frequency_rank").cast("long").alias("frequency_rank"),
    )


def land_rules(t):
    return [
        ("R1 returned", F.col("land_type").contains("R")),
        ("R2 small plot", F.col("land_size") < 3, F.concat(F.lit("size "), F.col("land_size").cast("int").cast("string"))),
        ("R3 per acre", F.col("price_scale") == "per acre"),
    ]


FLAGGED = f"""flagged AS (SELECT *, CASE WHEN contains(land_type, 'R') THEN 'R1 returned' WHEN land_size < 3 THEN 'R2 small plot'
  WHEN price_scale = 'per acre' THEN 'R3 per acre' END AS drop_rule FROM listings)"""


@query("C1_apply_rules", f"""
WITH {FLAGGED} SELECT {KEYS}, drop_rule, CASE WHEN drop_rule = 'R2 small plot' THEN 'size ' || CAST(land_size AS INT)
  WHEN drop_rule IS NOT NULL THEN '' END AS drop_note FROM flagged""")
def _(t):
    return rules.apply_rules(t.listings, land_rules(t)).select(*KEY, "drop_rule", "drop_note")


@query("C2_rule_counts", f"""
WITH {FLAGGED}, n AS (SELECT count(*) AS n0, count(*) FILTER (drop_rule = 'R1 returned') AS a,
  count(*) FILTER (drop_rule = 'R2 small plot') AS b, count(*) FILTER (drop_rule = 'R3 per acre') AS c FROM flagged)
SELECT CAST(1 AS BIGINT) AS step, 'R1 returned' AS drop_rule, n0 AS rows_before, a AS dropped, n0 - a AS remaining FROM n
UNION ALL SELECT 2, 'R2 small plot', n0 - a, b, n0 - a - b FROM n
UNION ALL SELECT 3, 'R3 per acre', n0 - a - b, c, n0 - a - b - c FROM n""")
def _(t):
    listed = land_rules(t)
    return rules.rule_counts(rules.apply_rules(t.listings, listed), [r[0] for r in listed])


def causes(df):
    with_median = attach_quantiles(df, ["division"], "unit_price", {"div_median": 0.5})
    return rules.classify_multi(with_median, [
        ("missing date", F.col("posted").isNull()),
        ("small plot", F.col("land_size") < 5),
        ("far from median", (F.col("unit_price") > 3 * F.col("div_median")) | (F.col("unit_price") < F.col("div_median") / 3)),
        ("scale mislabelled", (F.col("price_scale") == "total")
         & (F.col("total_price") / F.col("div_median")).between(*fv.SCALE_SWAP)),
    ])


CAUSES = """m AS (SELECT division, median(unit_price) AS dm FROM listings GROUP BY 1),
c AS (SELECT list_filter([CASE WHEN posted IS NULL THEN 'missing date' END, CASE WHEN land_size < 5 THEN 'small plot' END,
  CASE WHEN unit_price > 3 * dm OR unit_price < dm / 3 THEN 'far from median' END,
  CASE WHEN price_scale = 'total' AND total_price / dm BETWEEN CAST(1 AS DOUBLE)/3 AND 3 THEN 'scale mislabelled' END], lambda x: x IS NOT NULL) AS cs
  FROM listings l JOIN m USING (division)),
d AS (SELECT CASE WHEN len(cs) = 0 THEN ['no rule matched'] ELSE cs END AS causes FROM c)"""


@query("C3_classify_multi", f"WITH {CAUSES} SELECT cause, count(*) AS n FROM (SELECT unnest(causes) AS cause FROM d) GROUP BY 1")
def _(t):
    return rules.cause_counts(causes(t.listings))


@query("C3_cause_combinations", f"WITH {CAUSES} SELECT array_to_string(causes, ' + ') AS combination, count(*) AS n FROM d GROUP BY 1")
def _(t):
    return rules.cause_combinations(causes(t.listings))


@query("C4_scale_mislabel_filter", f"""
WITH p AS (SELECT *, CASE WHEN l_orderkey % 9 = 0 THEN unit_price ELSE total_price END AS raw FROM listings),
m AS (SELECT division, median(unit_price) AS r FROM p WHERE price_scale = 'per perch' GROUP BY 1)
SELECT {KEYS}, round(r, 6) AS ref_median, coalesce(price_scale = 'total' AND r > 0 AND raw / land_size / r < CAST(1 AS DOUBLE)/10
  AND raw / r BETWEEN CAST(1 AS DOUBLE)/3 AND 3, false) AS mislabelled FROM p LEFT JOIN m USING (division)""")
def _(t):
    raw = t.listings.withColumn("raw", F.when(F.col("l_orderkey") % 9 == 0, F.col("unit_price")).otherwise(F.col("total_price")))
    out = rules.scale_mislabel_filter(raw, "division", "price_scale", "raw", "land_size", "unit_price")
    return out.select(*KEY, r(F.col("ref_median"), 6).alias("ref_median"), "mislabelled")


@query("C5_ratio_outliers", f"""
WITH m AS (SELECT l_partkey, median(unit_price) AS r FROM listings WHERE price_scale = 'total' GROUP BY 1)
SELECT {KEYS}, round(unit_price / r, 6) AS ratio, CASE WHEN r IS NULL OR r <= 0 THEN 'no reference'
  WHEN unit_price / r > 2 OR unit_price / r < CAST(1 AS DOUBLE)/2 THEN 'outlier' ELSE 'ok' END AS verdict
FROM listings LEFT JOIN m USING (l_partkey)""")
def _(t):
    out = rules.ratio_outliers(t.listings, "l_partkey", "unit_price", F.col("price_scale") == "total", 2.0)
    return out.select(*KEY, r(F.col("ratio"), 6).alias("ratio"), "verdict")


@query("C6_censor_flag", f"SELECT {KEYS}, CAST(total_price >= 90000 AS INT) AS censored FROM listings")
def _(t):
    return t.listings.select(*KEY, numeric.censor_flag(F.col("total_price"), 90000).alias("censored"))


DIRTY = """d AS (SELECT c_custkey AS id, 'Shop ' || (c_custkey % 700) AS name,
  CASE WHEN c_custkey % 13 = 0 THEN 'n/a' ELSE CAST(5.60 + (c_custkey * 37 % 450) / CAST(100 AS DOUBLE) AS VARCHAR) END AS lat,
  CAST(79.80 + (c_custkey * 91 % 45) / CAST(1000 AS DOUBLE) AS VARCHAR) AS lon FROM customer)"""


@query("C7_clean_points", f"""
WITH {DIRTY}, e AS (SELECT *, try_cast(lat AS DOUBLE) AS la, try_cast(lon AS DOUBLE) AS lo FROM d),
f AS (SELECT *, CASE WHEN la IS NULL OR lo IS NULL THEN 'bad_coord' WHEN NOT (la BETWEEN 5.7 AND 10.0 AND lo BETWEEN 79.3 AND 82.1) THEN 'out_of_box' END AS r0 FROM e),
g AS (SELECT *, CASE WHEN r0 IS NULL AND id <> min(CASE WHEN r0 IS NULL THEN id END) OVER (PARTITION BY lower(name)) THEN 'dup_name' ELSE r0 END AS r1 FROM f),
h AS (SELECT *, CASE WHEN r1 IS NULL AND id <> min(CASE WHEN r1 IS NULL THEN id END) OVER (PARTITION BY round(la, 5), round(lo, 5)) THEN 'dup_coord' ELSE r1 END AS reason FROM g)
SELECT id, name, reason FROM h""")
def _(t):
    k = F.col("c_custkey")
    dirty = t.customer.select(
        k.alias("id"), F.concat(F.lit("Shop "), (k % 700).cast("string")).alias("name"),
        F.when(k % 13 == 0, "n/a").otherwise((5.60 + (k * 37 % 450) / 100.0).cast("string")).alias("lat"),
        (79.80 + (k * 91 % 45) / 1000.0).cast("string").alias("lon"),
    )
    return rules.clean_points(dirty, "name", "lat", "lon", [F.col("id")]).select("id", "name", "reason")


@query("C8_quantile_band", f"""
WITH b AS (SELECT quantile_cont(unit_price, 0.005) AS lo, quantile_cont(unit_price, 0.995) AS hi FROM listings)
SELECT {KEYS}, round(unit_price, 6) AS unit_price FROM listings, b WHERE unit_price BETWEEN lo AND hi""")
def _(t):
    return rules.quantile_band(t.listings, "unit_price").select(*KEY, r(F.col("unit_price"), 6).alias("unit_price"))


@query("C9_trim_per_group", f"""
SELECT {KEYS}, round(total_price, 2) AS total_price FROM (SELECT *, avg(total_price) OVER (PARTITION BY l_partkey) AS m,
  stddev_samp(total_price) OVER (PARTITION BY l_partkey) AS s FROM listings) WHERE s IS NULL OR abs(total_price - m) <= 1.5 * s""")
def _(t):
    return rules.trim_per_group(t.listings, "total_price", "l_partkey").select(*KEY, r(F.col("total_price"), 2).alias("total_price"))


@query("C10_trim_sweep", """
WITH s AS (SELECT abs(unit_price - avg(unit_price) OVER (PARTITION BY division)) AS off, stddev_samp(unit_price) OVER (PARTITION BY division) AS sd FROM listings),
k AS (SELECT unnest([1.0, 1.5, 2.0, 2.5, 3.0])::DOUBLE AS k)
SELECT k, count(*) FILTER (sd IS NULL OR off <= k * sd) AS rows_kept, count(*) FILTER (NOT (sd IS NULL OR off <= k * sd)) AS rows_dropped
FROM s, k GROUP BY k""")
def _(t):
    return rules.trim_sweep(t.listings, "unit_price", "division", [1.0, 1.5, 2.0, 2.5, 3.0])


@query("C11_band_grade", """
SELECT o_custkey, count(*) AS n, CASE WHEN count(*) >= 50 THEN 'high' WHEN count(*) >= 10 THEN 'medium' WHEN count(*) >= 1 THEN 'low' ELSE 'none' END AS grade
FROM orders GROUP BY 1""")
def _(t):
    counts = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return counts.withColumn("grade", numeric.band_grade(F.col("n")))


@query("C12_priority_label", """
SELECT user_id, count(*) AS n, CASE WHEN count(*) FILTER (event_type = 'error') >= 50 OR max(value) >= 100 THEN 'High'
  WHEN count(*) FILTER (event_type = 'error') >= 1 THEN 'Medium' WHEN count(*) >= 5 THEN 'Low' ELSE 'No official record' END AS label
FROM events GROUP BY 1""")
def _(t):
    per_user = t.events.groupBy("user_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.max("value").alias("peak")
    )
    label = numeric.first_true(
        [((F.col("errors") >= 50) | (F.col("peak") >= 100), "High"), (F.col("errors") >= 1, "Medium"), (F.col("n") >= 5, "Low")],
        "No official record",
    )
    return per_user.select("user_id", "n", label.alias("label"))


@query("C13_split_by_lookup", """
WITH d AS (SELECT n_nationkey, 'zone' || (n_nationkey % 3) AS cls FROM nation WHERE n_nationkey % 6 <> 5)
SELECT coalesce(cls, 'default') AS bucket, count(*) AS n, round(sum(c_acctbal), 2) AS balance
FROM customer LEFT JOIN d ON c_nationkey = n_nationkey GROUP BY 1""")
def _(t):
    dim = t.nation.filter("n_nationkey % 6 <> 5").select(
        F.col("n_nationkey").alias("c_nationkey"), F.concat(F.lit("zone"), (F.col("n_nationkey") % 3).cast("string")).alias("cls")
    )
    routed = rules.split_by_lookup(t.customer, dim, "c_nationkey", "cls", "default")
    return routed.groupBy("bucket").agg(F.count("*").alias("n"), r(F.sum("c_acctbal"), 2).alias("balance"))


@query("C14_drop_constant_or_identical_columns", """
WITH b AS (SELECT l_quantity AS size, l_quantity AS size_copy, 1 AS one, CAST(NULL AS DOUBLE) AS nothing, l_discount AS discount FROM lineitem),
s AS (SELECT bool_and(size IS NOT DISTINCT FROM size_copy) AS e, min(one) = max(one) AS c, count(nothing) AS z, bool_and(size IS NOT DISTINCT FROM discount) AS f FROM b)
SELECT 'size' AS "column", 'keep' AS verdict, CAST(NULL AS VARCHAR) AS same_as FROM s
UNION ALL SELECT 'size_copy', CASE WHEN e THEN 'identical' ELSE 'keep' END, CASE WHEN e THEN 'size' END FROM s
UNION ALL SELECT 'one', CASE WHEN c THEN 'constant' ELSE 'keep' END, NULL FROM s
UNION ALL SELECT 'nothing', CASE WHEN z = 0 THEN 'all null' ELSE 'keep' END, NULL FROM s
UNION ALL SELECT 'discount', CASE WHEN f THEN 'identical' ELSE 'keep' END, CASE WHEN f THEN 'size' END FROM s""")
def _(t):
    wide = t.lineitem.select(
        F.col("l_quantity").alias("size"), F.col("l_quantity").alias("size_copy"), F.lit(1).alias("one"),
        F.lit(None).cast("double").alias("nothing"), F.col("l_discount").alias("discount"),
    )
    return rules.column_redundancy(wide, wide.columns)


@query("C15_junk_string_filter", """
WITH s AS (SELECT CASE p_partkey % 7 WHEN 0 THEN upper(p_name) WHEN 1 THEN CAST(p_partkey AS VARCHAR) ELSE p_name END AS v FROM part),
c AS (SELECT v AS spelling, count(*) AS n FROM s WHERE NOT regexp_matches(v, '^[0-9 ]+$') GROUP BY 1)
SELECT lower(spelling) AS key, arg_min(spelling, (-n, spelling)) AS spelling, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1""")
def _(t):
    k = F.col("p_partkey")
    mixed = t.part.select(
        F.when(k % 7 == 0, F.upper("p_name")).when(k % 7 == 1, k.cast("string")).otherwise(F.col("p_name")).alias("v")
    )
    return rules.frequent_spellings(mixed, "v", r"^[0-9 ]+$")




@query("C1_title_word_rules", """
SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'rent|lease|leasing|monthly|per month|p/m') THEN 'R1 rent/lease listing'
  WHEN source = 'src3' OR regexp_matches(lower(text), 'apartment|flat|annex|condo|penthouse|storey house|storied house|bedroom|br house|villa|bungalow|mansion|hotel|guest house|warehouse|factory|showroom|shop|office space|building for')
  THEN 'R2 non-land record' END AS drop_rule FROM documents""")
def _(t):
    flagged = rules.apply_rules(t.documents, [
        ("R1 rent/lease listing", text.has_any_substring(F.col("text"), fv.RENT_WORDS)),
        ("R2 non-land record", (F.col("source") == "src3") | text.has_any_substring(F.col("text"), fv.NON_LAND_TITLE_WORDS)),
    ])
    return flagged.select("doc_id", "drop_rule")
