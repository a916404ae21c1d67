"""Group profiles and contrasts."""

from pyspark.sql import functions as F

from parcelytics.catalog.registry import query
from parcelytics.catalog.registry import rounded as r
from parcelytics.catalog.views import blocks_sql
from parcelytics.functions import text
from parcelytics.operators import aggregates as agg
from parcelytics.operators import rules
from parcelytics.plans.scale import exact_quantiles


@query("E1_group_summary", """
SELECT land_type, count(*) AS n, round(sum(unit_price), 2) AS total, round(median(unit_price), 4) AS median, round(quantile_cont(unit_price, 0.25), 4) AS q1,
  round(quantile_cont(unit_price, 0.75), 4) AS q3, round(quantile_cont(unit_price, 0.75) - quantile_cont(unit_price, 0.25), 4) AS iqr,
  round(min(unit_price), 4) AS min, round(max(unit_price), 4) AS max FROM listings GROUP BY 1""")
def _(t):
    out = agg.group_summary(t.listings, ["land_type"], "unit_price")
    return out.select("land_type", "n", r(F.col("sum"), 2).alias("total"), *[r(c, 4) for c in ["median", "q1", "q3", "iqr", "min", "max"]])


@query("E2_conditional_agg", """
SELECT division, round(median(unit_price) FILTER (price_scale = 'per perch'), 6) AS ref_median, count(*) FILTER (price_scale = 'per perch') AS n_ref FROM listings GROUP BY 1""")
def _(t):
    medians = rules.reference_median(t.listings, "division", "unit_price", F.col("price_scale") == "per perch")
    counts = t.listings.groupBy("division").agg(F.count_if(F.col("price_scale") == "per perch").alias("n_ref"))
    return counts.join(medians, "division", "left").select("division", r("ref_median"), "n_ref")


@query("E3_weighted_centroid", """
WITH u AS (SELECT *, CASE WHEN unit_id % 5 = 0 THEN NULL WHEN nation = 3 THEN 0 ELSE area END AS w FROM units)
SELECT nation, round(coalesce(sum(lat * coalesce(w, 0)) / nullif(sum(coalesce(w, 0)), 0), avg(lat)), 6) AS lat,
  round(coalesce(sum(lon * coalesce(w, 0)) / nullif(sum(coalesce(w, 0)), 0), avg(lon)), 6) AS lon FROM u GROUP BY 1""")
def _(t):
    weighted = t.units.withColumn("w", F.when(F.col("unit_id") % 5 == 0, None).when(F.col("nation") == 3, 0.0).otherwise(F.col("area")))
    return agg.weighted_centroid(weighted, ["nation"], "w", ["lat", "lon"]).select("nation", r("lat"), r("lon"))


@query("E4_merge_units", """
SELECT n_regionkey, count(*) AS n_members, string_agg(n_name, ' | ' ORDER BY n_nationkey) AS members,
  array_to_string(list_sort(list_distinct(list(CAST(n_nationkey % 3 AS VARCHAR)))), ' | ') AS parents, CAST(sum(n_nationkey) AS BIGINT) AS total FROM nation GROUP BY 1""")
def _(t):
    df = t.nation.withColumn("parent", F.col("n_nationkey") % 3)
    return agg.merge_units(df, ["n_regionkey"], F.col("n_nationkey"), {"members": "n_name"}, {"parents": "parent"}, {"total": "n_nationkey"})


@query("E5_totals_row", """
SELECT CASE WHEN grouping(land_type) = 1 THEN 'TOTAL' ELSE land_type END AS land_type, count(*) AS n, round(sum(total_price), 2) AS total
FROM listings GROUP BY ROLLUP (land_type)""")
def _(t):
    return agg.totals_row(t.listings, "land_type", [F.count("*").alias("n"), r(F.sum("total_price"), 2).alias("total")])


@query("E6_sample_members", """
WITH d AS (SELECT o_orderpriority, o_custkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey) rn FROM (SELECT DISTINCT o_orderpriority, o_custkey FROM orders)),
s AS (SELECT o_orderpriority, string_agg(CAST(o_custkey AS VARCHAR), ', ' ORDER BY rn) AS sample FROM d WHERE rn <= 3 GROUP BY 1)
SELECT o.o_orderpriority, count(*) AS n, min(o_custkey) AS first_member, count(DISTINCT o_custkey) AS n_members, any_value(sample) AS sample
FROM orders o JOIN s ON o.o_orderpriority = s.o_orderpriority GROUP BY 1""")
def _(t):
    return agg.sample_members(t.orders, ["o_orderpriority"], "o_custkey")


@query("E7_determinism_check", """
WITH p AS (SELECT l_partkey, land_type, count(*) AS n FROM listings GROUP BY 1, 2)
SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY l_partkey) AS n_values FROM p) WHERE n_values > 1""")
def _(t):
    return agg.dependency_violations(t.listings, "l_partkey", "land_type")


@query("E8_dup_groups", """
WITH s AS (SELECT count(*) AS group_size FROM documents GROUP BY text)
SELECT group_size, count(*) AS groups, CAST(sum(group_size) AS BIGINT) AS rows, CAST(sum(group_size - 1) AS BIGINT) AS removed FROM s GROUP BY 1""")
def _(t):
    return agg.dup_groups(t.documents, ["text"])


EVIDENCE = """k AS (SELECT o_custkey AS cust, o_orderstatus AS status, o_orderpriority || '#' || o_orderkey AS body, o_orderdate AS d, o_orderkey AS o FROM orders),
f AS (SELECT cust, status, count(*) AS n, arg_min(body, o) AS fb, min(o) AS fo, date_diff('day', min(d), max(d)) AS span_days, count(DISTINCT d) AS n_dates FROM k GROUP BY 1, 2 HAVING count(*) > 1),
s AS (SELECT k.cust, k.status, 1 - levenshtein(body, fb) / CAST(greatest(length(body), length(fb)) AS DOUBLE) AS sim FROM k JOIN f ON k.cust = f.cust AND k.status = f.status AND k.o <> f.fo)"""


def evidence(t, similarity=text.edit_ratio):
    df = t.orders.select(
        F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status"),
        F.concat_ws("#", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("body"),
        F.col("o_orderdate").alias("d"), F.col("o_orderkey").alias("o"),
    )
    return agg.dup_evidence(df, ["cust", "status"], F.col("o"), "body", "d", {"n_dates": "d"}, similarity)


@query("E9_dup_evidence", f"""WITH {EVIDENCE}
SELECT f.cust, f.status, any_value(n) AS n, CAST(any_value(span_days) AS INT) AS span_days, any_value(n_dates) AS n_dates, round(min(sim), 6) AS min_similarity, round(avg(sim), 6) AS mean_similarity
FROM f JOIN s ON f.cust = s.cust AND f.status = s.status GROUP BY 1, 2""")
def _(t):
    return evidence(t).select("cust", "status", "n", "span_days", "n_dates", r("min_similarity"), r("mean_similarity"))


THRESHOLDS = [0.99, 0.95, 0.90, 0.85, 0.80, 0.70, 0.60]


@query("E10_near_dup_buckets", f"""WITH {EVIDENCE}, m AS (SELECT min(sim) AS lo FROM s GROUP BY cust, status), x AS (SELECT unnest({THRESHOLDS})::DOUBLE AS threshold)
SELECT threshold, count(*) FILTER (lo >= threshold) AS n FROM m, x GROUP BY 1""")
def _(t):
    return agg.threshold_counts(evidence(t), "min_similarity", THRESHOLDS)


EVIDENCE_BLOCKS = EVIDENCE.partition("s AS (")[0] + blocks_sql("SELECT fb AS a, body AS b FROM k JOIN f ON k.cust = f.cust AND k.status = f.status AND k.o <> f.fo") + """,
s AS (SELECT k.cust, k.status, ratio AS sim FROM k JOIN f ON k.cust = f.cust AND k.status = f.status AND k.o <> f.fo JOIN mr ON a = fb AND b = body)"""


@query("E9_dup_evidence_blocks", f"""WITH RECURSIVE {EVIDENCE_BLOCKS}
SELECT f.cust, f.status, any_value(n) AS n, CAST(any_value(span_days) AS INT) AS span_days, any_value(n_dates) AS n_dates, round(min(sim), 6) AS min_similarity, round(avg(sim), 6) AS mean_similarity
FROM f JOIN s ON f.cust = s.cust AND f.status = s.status GROUP BY 1, 2""")
def _(t):
    return evidence(t, agg.member_blocks).select("cust", "status", "n", "span_days", "n_dates", r("min_similarity"), r("mean_similarity"))


@query("E10_near_dup_buckets_blocks", f"""WITH RECURSIVE {EVIDENCE_BLOCKS}, m AS (SELECT min(sim) AS lo FROM s GROUP BY cust, status), x AS (SELECT unnest({THRESHOLDS})::DOUBLE AS threshold)
SELECT threshold, count(*) FILTER (lo >= threshold) AS n FROM m, x GROUP BY 1""")
def _(t):
    return agg.threshold_counts(evidence(t, agg.member_blocks), "min_similarity", THRESHOLDS)


@query("E11_value_counts", """
SELECT o_orderpriority, count(*) AS n, round(100 * count(*) / CAST((SELECT count(*) FROM orders) AS DOUBLE), 6) AS share_pct FROM orders GROUP BY 1""")
def _(t):
    return agg.value_counts(t.orders, "o_orderpriority").select("o_orderpriority", "n", r("share_pct"))


@query("E12_missing_profile", """
WITH o AS (SELECT CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_custkey AS DOUBLE) END AS cust FROM orders)
SELECT 'price' AS "column", count(*) - count(price) AS missing, round(100 * (count(*) - count(price)) / CAST(count(*) AS DOUBLE), 6) AS missing_pct, min(price) AS min, round(median(price), 4) AS median, round(avg(price), 4) AS mean, max(price) AS max FROM o
UNION ALL SELECT 'cust', count(*) - count(cust), round(100 * (count(*) - count(cust)) / CAST(count(*) AS DOUBLE), 6), min(cust), round(median(cust), 4), round(avg(cust), 4), max(cust) FROM o""")
def _(t):
    df = t.orders.select(
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey").cast("double")).alias("cust"),
    )
    out = agg.missing_profile(df, ["price", "cust"])
    return out.select("column", "missing", r("missing_pct"), "min", r("median", 4), r("mean", 4), "max")


@query("E13_full_row_duplicates", """
WITH e AS (SELECT user_id, event_type, CAST(floor(value / 10) AS BIGINT) AS v, count(*) AS n FROM events GROUP BY 1, 2, 3)
SELECT count(*) FILTER (n > 1) AS repeated_rows, CAST(sum(n - 1) AS BIGINT) AS extra_rows FROM e""")
def _(t):
    return agg.full_row_duplicates(t.events.select("user_id", "event_type", F.floor(F.col("value") / 10).alias("v")))


@query("E14_event_fold_by_key", """
WITH e AS (SELECT o_custkey AS k, o_orderdate AS d, o_totalprice AS v FROM orders WHERE o_orderstatus = 'F'),
g AS (SELECT k, count(*) AS records, count(DISTINCT year(d)) AS years, min(d) AS first, max(d) AS last, sum(v) AS v FROM e GROUP BY 1)
SELECT c_custkey AS k, coalesce(records, 0) AS records, coalesce(years, 0) AS years, strftime(first, '%Y-%m-%d') AS first, strftime(last, '%Y-%m-%d') AS last, round(coalesce(v, 0), 2) AS v
FROM customer LEFT JOIN g ON c_custkey = k""")
def _(t):
    flood = t.orders.filter("o_orderstatus = 'F'").select(
        F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("d"), F.col("o_totalprice").alias("v"))
    out = agg.event_fold_by_key(flood, "k", t.customer.select(F.col("c_custkey").alias("k")), "d", ["v"])
    return out.select("k", "records", "years", F.date_format("first", "yyyy-MM-dd").alias("first"),
                      F.date_format("last", "yyyy-MM-dd").alias("last"), r("v", 2))


@query("E15_year_list_per_key", """
SELECT o_custkey, array_to_string(list_sort(list_distinct(list(year(o_orderdate)))), ' ') AS years FROM orders GROUP BY 1""")
def _(t):
    out = agg.year_list_per_key(t.orders, "o_custkey", "o_orderdate")
    return out.select("o_custkey", F.array_join(F.transform("years", lambda y: y.cast("string")), " ").alias("years"))


@query("E16_multi_membership_sum", """
WITH m AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part),
d AS (SELECT w, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part WHERE p_size > 10) GROUP BY 1 HAVING w <> 'ring')
SELECT p_partkey, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n FROM m LEFT JOIN d USING (w) GROUP BY 1""")
def _(t):
    dim = t.part.filter("p_size > 10").select(F.explode(F.split("p_name", " ")).alias("w")).groupBy("w").agg(F.count("*").alias("n")).filter("w <> 'ring'")
    return agg.multi_membership_sum(t.part, "p_partkey", "p_name", dim, "w", "n", " ")


@query("E17_division_lookup", """
SELECT division, count(*) AS listing_count, median(land_size) AS land_size, round(median(total_price), 4) AS total_price, round(median(discount), 6) AS discount FROM listings GROUP BY 1""")
def _(t):
    out = agg.division_lookup(t.listings, "division", ["land_size", "total_price", "discount"])
    return out.select("division", "listing_count", "land_size", r("total_price", 4), r("discount"))


@query("E18_global_row", """
WITH d AS (SELECT division, median(land_size) AS a, median(total_price) AS b FROM listings GROUP BY 1)
SELECT median(a) AS land_size, round(median(b), 4) AS total_price FROM d""")
def _(t):
    lookup = agg.division_lookup(t.listings, "division", ["land_size", "total_price"])
    return agg.global_row(lookup, ["land_size", "total_price"]).select("land_size", r("total_price", 4))


HIST = """
WITH v AS (SELECT {expr} AS x FROM listings), e AS (SELECT min(x) AS lo, max(x) AS hi, (max(x) - min(x)) / 20 AS w FROM v),
c AS (SELECT CAST(least(floor((x - lo) / w), 19) AS BIGINT) AS bin, count(*) AS n FROM v, e GROUP BY 1)
SELECT b.bin, round(lo + b.bin * w, 6) AS left_edge, round(lo + (b.bin + 1) * w, 6) AS right_edge, coalesce(n, 0) AS n
FROM (SELECT unnest(range(0, 20)) AS bin) b CROSS JOIN e LEFT JOIN c ON b.bin = c.bin"""


@query("E19_histogram", HIST.format(expr="unit_price"))
def _(t):
    return agg.histogram(t.listings, "unit_price", 20).select("bin", r("left_edge"), r("right_edge"), "n")


@query("E19_log_histogram", HIST.format(expr="ln(unit_price)"))
def _(t):
    logged = t.listings.select(F.log("unit_price").alias("y"))
    return agg.histogram(logged, "y", 20).select("bin", r("left_edge"), r("right_edge"), "n")


@query("E20_moments", """
SELECT land_type, count(unit_price) AS n, round(avg(unit_price), 4) AS mean, round(stddev_samp(unit_price), 4) AS sd, round(skewness(unit_price), 5) AS skew,
  round(min(unit_price), 4) AS min, round(max(unit_price), 4) AS max FROM listings GROUP BY 1""")
def _(t):
    out = agg.moments(t.listings, "unit_price", ["land_type"])
    return out.select("land_type", "n", r("mean", 4), r("sd", 4), r("skew", 5), r("min", 4), r("max", 4))


def corr_sql(source, cols):
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM {source}" for a, b in pairs)


COLS = ["land_size", "total_price", "unit_price", "discount", "tax"]


@query("E21_corr_matrix_rows", corr_sql("listings", COLS))
def _(t):
    return agg.corr_matrix(t.listings, COLS).select("a", "b", r("r"))


@query("E21_corr_matrix_groups", "WITH g AS (SELECT division, " + ", ".join(f"arg_min({c}, (l_orderkey, l_linenumber, l_partkey, total_price, discount, tax)) FILTER (l_orderkey % 3 <> 0) AS {c}" for c in COLS)
       + " FROM listings GROUP BY 1) " + corr_sql("g", COLS))
def _(t):
    order = [F.col(c) for c in ["l_orderkey", "l_linenumber", "l_partkey", "total_price", "discount", "tax"]]
    sparse = t.listings.select("division", "l_orderkey", "l_linenumber", "l_partkey", *[F.when(F.col("l_orderkey") % 3 != 0, F.col(c)).alias(c) for c in COLS])
    return agg.corr_matrix(agg.group_basis(sparse, "division", COLS, order), COLS).select("a", "b", r("r"))


RANKED = """(SELECT *, rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / CAST(2 AS DOUBLE) AS {1} FROM {2})"""


@query("E22_spearman", f"""
WITH a AS {RANKED.format('land_size', 'rx', 'listings')}, b AS {RANKED.format('unit_price', 'ry', 'a')}
SELECT count(*) AS n, round(corr(rx, ry), 6) AS rho FROM b""")
def _(t):
    return agg.spearman(t.listings, "land_size", "unit_price").select("n", r("rho"))


@query("E23_group_median_contrast", f"""
WITH d AS (SELECT unit_price AS v, land_type = 'N_O' AS g FROM listings WHERE land_type IN ('N_O', 'A_F')), a AS {RANKED.format('v', 'rk', 'd')},
s AS (SELECT CAST(count(*) FILTER (g) AS DOUBLE) AS n1, CAST(count(*) FILTER (NOT g) AS DOUBLE) AS n2, sum(rk) FILTER (g) AS r1, median(v) FILTER (g) AS median1, median(v) FILTER (NOT g) AS median2 FROM a),
ti AS (SELECT sum(k * k * k - k) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS k FROM d GROUP BY v)),
u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u FROM s, ti)
SELECT CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round(median1, 4) AS median1, round(median2, 4) AS median2, u,
  round((u - n1 * n2 / 2) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))), 6) AS z FROM u""")
def _(t):
    out = agg.mann_whitney(t.listings.filter(F.col("land_type").isin("N_O", "A_F")), "unit_price", F.col("land_type") == "N_O")
    return out.select("n1", "n2", r("median1", 4), r("median2", 4), "u", r("z"))


CONFIGS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("E24_pivot_compare", "SELECT seed, " + ", ".join(f"round(max(CASE WHEN config = '{c}' THEN metric END), 6) AS \"{c}\"" for c in CONFIGS) + ", "
       + ", ".join(f"round(max(CASE WHEN config = '{c}' THEN metric END) - max(CASE WHEN config = '1-URGENT' THEN metric END), 6) AS \"delta_{c}\"" for c in CONFIGS[1:])
       + " FROM runs GROUP BY 1")
def _(t):
    out = agg.pivot_compare(t.runs, "seed", "config", CONFIGS, "metric", "1-URGENT")
    return out.select("seed", *[r(F.col(f"`{c}`"), 6).alias(c) for c in out.columns if c != "seed"])


@query("E25_block_share", """
WITH s AS (SELECT land_type, CASE WHEN land_type IN ('A_F', 'A_O') THEN 'block a' WHEN land_type = 'N_F' THEN 'block n' ELSE 'other' END AS block, avg(unit_price) AS v FROM listings GROUP BY 1, 2),
b AS (SELECT block, sum(v) AS total, count(*) AS n_features FROM s GROUP BY 1)
SELECT block, round(total, 4) AS total, n_features, round(100 * total / (SELECT sum(total) FROM b), 6) AS share_pct FROM b""")
def _(t):
    means = t.listings.groupBy("land_type").agg(F.avg("unit_price").alias("v"))
    out = agg.block_share(means, "land_type", "v", {"A_F": "block a", "A_O": "block a", "N_F": "block n"}, "other")
    return out.select("block", r("total", 4), "n_features", r("share_pct"))


@query("E26_address_registry_dedup", """
WITH a AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 10 = 0 THEN '' ELSE trim(regexp_replace(regexp_replace(regexp_replace(lower('No. ' || (p_partkey % 90) || ', ' || p_name || ' Rd'), '[^a-z0-9]+', ' ', 'g'), '\\b(no|nos|sri|lanka)\\b', ' ', 'g'), '\\s+', ' ', 'g')) END AS addr FROM part)
SELECT coalesce(nullif(addr, ''), '__nokey__' || p_partkey) AS key, min(p_partkey) AS p_partkey, arg_min(p_name, p_partkey) AS p_name, count(*) AS n_merged,
  array_to_string(list_sort(list(p_partkey)), ' ') AS codes FROM a GROUP BY 1""")
def _(t):
    raw = F.concat(F.lit("No. "), (F.col("p_partkey") % 90).cast("string"), F.lit(", "), F.col("p_name"), F.lit(" Rd"))
    address = F.when(F.col("p_partkey") % 10 == 0, F.lit("")).otherwise(text.norm_address(raw))
    return agg.registry_dedup(t.part, "p_partkey", "p_name", address)


@query("E27_keyed_counts", "SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def _(t):
    return agg.keyed_counts(t.events, "user_id")
