"""Splits, training, metrics, ablation statistics and attributions."""

from pyspark.sql import functions as F

from parcelytics.catalog.registry import query
from parcelytics.catalog.registry import rounded as r
from parcelytics.operators import aggregates, features as ft
from parcelytics.operators import modelling as ml
from parcelytics.operators.tree_attribution import tree_attributions

FEATURES = ["land_size", "discount", "tax", "Land_type_A_F", "Land_type_N_O"]
ROW = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
IS_TEST = "CAST('0x' || substr(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, '42')), 1, 12) AS BIGINT) % 1000000 < 200000"


def training(t):
    """Listings with the log target, two land-type flags and the fold column."""
    df = t.listings.withColumn("y", F.log("unit_price"))
    return ft.one_hot(df, "land_type", ["A_F", "N_O"], "Land_type")


SCORED = """s AS (SELECT *, ln(unit_price) AS y, CAST(7.2 AS DOUBLE) + discount * 3 - land_size / 500 AS p FROM listings)"""


def scored(t):
    return t.listings.withColumn("y", F.log("unit_price")).withColumn("p", 7.2 + F.col("discount") * 3 - F.col("land_size") / 500)


@query("M1_random_split", f"SELECT *, {IS_TEST} AS is_test FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM listings)")
def _(t):
    return ml.random_split(t.listings, ROW, 0.2, 42).select(*ROW, "is_test")


@query("M2_source_aware_split", f"SELECT land_type, {IS_TEST} AND coalesce(land_type <> 'R_F', true) AS is_test, count(*) AS n FROM listings GROUP BY ALL")
def _(t):
    out = ml.source_aware_split(t.listings, ROW, F.col("land_type") == "R_F", 0.2, 42)
    return out.groupBy("land_type", "is_test").agg(F.count("*").alias("n"))


def folds_sql(tie):
    """The greedy walk itself: largest group first, each to the first of the lightest folds."""
    return f"""
WITH RECURSIVE g AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY n DESC, {tie}) AS rn FROM g),
w AS (SELECT CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS o_custkey, CAST(NULL AS BIGINT) AS n, CAST([0, 0, 0, 0, 0] AS BIGINT[]) AS loads, 0 AS fold
  UNION ALL SELECT o.rn, o.o_custkey, o.n, [CASE WHEN i = list_position(loads, list_min(loads)) THEN loads[i] + o.n ELSE loads[i] END FOR i IN range(1, 6)], CAST(list_position(loads, list_min(loads)) - 1 AS INTEGER)
  FROM w JOIN o ON o.rn = w.rn + 1)
SELECT o_custkey, n, fold FROM w WHERE rn > 0"""


@query("M3_group_folds", folds_sql("o_custkey"))
def _(t):
    return ml.group_folds(t.orders, "o_custkey", 5)


@query("M4_shuffled_group_folds", folds_sql("CAST('0x' || substr(md5(concat_ws('|', o_custkey, '7')), 1, 12) AS BIGINT), o_custkey"))
def _(t):
    return ml.shuffled_group_folds(t.orders, "o_custkey", 5, 7)


@query("M5_fit_regressor")
def _(t):
    data = ml.random_split(training(t), ROW, 0.2, 42)
    models = {"forest": {"numTrees": 8, "maxDepth": 5}, "boosted": {"maxIter": 4, "maxDepth": 4}, "linear": {}}
    return ml.fit_and_score(data, "is_test", FEATURES, "y", {kind: (kind, params) for kind, params in models.items()})


@query("M5_fit_second_order")
def _(t):
    data = ml.random_split(training(t), ROW, 0.2, 42)
    params = {"rounds": 6, "depth": 4, "rate": 0.3, "l2": 2.0, "column_share": 0.6}
    return ml.fit_and_score(data, "is_test", FEATURES, "y", {"second_order": ("second_order", params)}).drop("model")


# a linear model of one feature has a closed form
LINE = f"""d AS (SELECT fold, coalesce(land_size, 0) AS x, ln(unit_price) AS y, {IS_TEST} AS is_test FROM listings)"""
SCORES = """count(*) AS n, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)) AS r2, sqrt(avg((y - p) * (y - p))) AS rmse_log, avg(abs(y - p)) AS mae_log,
  avg(abs(exp(y) - exp(p))) AS mae, avg(100 * abs(exp(y) - exp(p)) / exp(y)) AS mape, median(100 * abs(exp(y) - exp(p)) / exp(y)) AS median_ape"""
ROUNDED = "round(r2, 5) AS r2, round(rmse_log, 5) AS rmse_log, round(mae_log, 5) AS mae_log, round(mae, 2) AS mae, round(mape, 4) AS mape, round(median_ape, 4) AS median_ape"


def rounded_scores(out):
    return out.select(*[c for c in ("fold", "n") if c in out.columns], r("r2", 5), r("rmse_log", 5), r("mae_log", 5), r("mae", 2), r("mape", 4), r("median_ape", 4))


@query("M5_fit_linear", f"""
WITH {LINE}, f AS (SELECT regr_slope(y, x) AS k, regr_intercept(y, x) AS c FROM d WHERE NOT is_test), s AS (SELECT y, c + k * x AS p FROM d CROSS JOIN f WHERE is_test)
SELECT n, {ROUNDED} FROM (SELECT {SCORES} FROM s)""")
def _(t):
    data = ml.random_split(training(t), ROW, 0.2, 42)
    return rounded_scores(ml.fit_and_score(data, "is_test", ["land_size"], "y", {"linear": ("linear", {})}))


@query("M10_cross_validate_linear", f"""
WITH {LINE}, f AS (SELECT g.fold, regr_slope(y, x) AS k, regr_intercept(y, x) AS c FROM (SELECT DISTINCT fold FROM d) g JOIN d ON d.fold <> g.fold GROUP BY 1),
s AS (SELECT d.fold, y, c + k * x AS p FROM d JOIN f ON d.fold = f.fold), m AS (SELECT CAST(fold AS VARCHAR) AS fold, {SCORES} FROM s GROUP BY 1)
SELECT fold, n, {ROUNDED} FROM m UNION ALL
SELECT 'mean', CAST(sum(n) AS BIGINT), round(avg(r2), 5), round(avg(rmse_log), 5), round(avg(mae_log), 5), round(avg(mae), 2), round(avg(mape), 4), round(avg(median_ape), 4) FROM m""")
def _(t):
    return rounded_scores(ml.cross_validate(training(t), ["land_size"], "y", "fold", None, "linear"))


@query("M6_random_search_cv")
def _(t):
    return ml.random_search_cv(training(t), FEATURES, "y", "fold", "forest", {"numTrees": [3, 6], "maxDepth": [3, 5]}, 3, 5)


@query("M7_rfe_cv")
def _(t):
    return ml.rfe_cv(training(t), FEATURES, "y", "fold", "linear", step=2)


@query("M8_ensemble_mean", f"""
WITH {SCORED}, g AS (SELECT division, avg(y) AS a, avg(p) AS b, avg(p) + 0.25 AS c FROM s GROUP BY 1) SELECT division, round((a + b + c) / 3, 6) AS prediction FROM g""")
def _(t):
    means = scored(t).groupBy("division").agg(F.avg("y").alias("a"), F.avg("p").alias("b"))
    parts = [means.select("division", F.col("a").alias("v")), means.select("division", F.col("b").alias("v")), means.select("division", (F.col("b") + 0.25).alias("v"))]
    return ml.ensemble_mean(parts, ["division"], "v").select("division", r("prediction"))


@query("M9_metrics", f"""
WITH {SCORED} SELECT land_type, count(*) AS n, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)), 6) AS r2, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse_log, round(avg(abs(y - p)), 6) AS mae_log,
  round(avg(abs(exp(y) - exp(p))), 3) AS mae, round(avg(100 * abs(exp(y) - exp(p)) / exp(y)), 5) AS mape, round(median(100 * abs(exp(y) - exp(p)) / exp(y)), 5) AS median_ape FROM s GROUP BY 1""")
def _(t):
    out = ml.metrics(scored(t), "y", "p", ["land_type"])
    return out.select("land_type", "n", r("r2"), r("rmse_log"), r("mae_log"), r("mae", 3), r("mape", 5), r("median_ape", 5))


@query("M10_cross_validate")
def _(t):
    return ml.cross_validate(training(t), FEATURES, "y", "fold", "division", "forest", numTrees=5, maxDepth=5)


@query("M11_ablation")
def _(t):
    def folds_of(df, seed):
        return df.drop("fold").withColumn("fold", F.pmod(F.xxhash64("division", F.lit(seed)), F.lit(3)).cast("int"))

    return ml.ablation(training(t), ["land_size"], ["discount", "tax"], "y", folds_of, [1, 2], kind="linear")


# least squares of one and of two features from means, variances and covariances of the other folds
def fits_sql(fold):
    return f"""o AS (SELECT {fold} AS fold, coalesce(land_size, 0) AS a, coalesce(discount, 0) AS b, ln(unit_price) AS y FROM listings),
g AS (SELECT h.fold, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) AS saa, var_pop(b) AS sbb, covar_pop(a, b) AS sab, covar_pop(a, y) AS say, covar_pop(b, y) AS sby, sum(a * y) / sum(a * a) AS origin
  FROM (SELECT DISTINCT fold FROM o) h JOIN o ON o.fold <> h.fold GROUP BY 1),
k AS (SELECT *, (say * sbb - sby * sab) / (saa * sbb - sab * sab) AS ka, (sby * saa - say * sab) / (saa * sbb - sab * sab) AS kb FROM g),
e AS (SELECT fold, var_pop(y) * count(y) AS total, sum((y - my - ka * (a - ma) - kb * (b - mb)) ** 2) AS both_left, sum((y - my - say / saa * (a - ma)) ** 2) AS a_left, sum((y - my - sby / sbb * (b - mb)) ** 2) AS b_left,
  sum((y - origin * a) ** 2) AS origin_left FROM o JOIN k USING (fold) GROUP BY 1),
m AS (SELECT avg(1 - both_left / total) AS both_r2, avg(1 - a_left / total) AS a_r2, avg(1 - b_left / total) AS b_r2, avg(1 - origin_left / total) AS origin_r2 FROM e)"""


@query("M6_random_search_cv_linear", f"""
WITH {fits_sql("fold")} SELECT '{{''fitIntercept'': True}}' AS params, round(a_r2, 6) AS mean_r2 FROM m UNION ALL SELECT '{{''fitIntercept'': False}}', round(origin_r2, 6) FROM m""")
def _(t):
    out = ml.random_search_cv(training(t), ["land_size"], "y", "fold", "linear", {"fitIntercept": [True, False]}, 2, 5)
    return out.select("params", r("mean_r2"))


@query("M7_rfe_cv_linear", f"""
WITH {fits_sql("fold")}, w AS (SELECT abs(covar_pop(a, y) * var_pop(b) - covar_pop(b, y) * covar_pop(a, b)) > abs(covar_pop(b, y) * var_pop(a) - covar_pop(a, y) * covar_pop(a, b)) AS a_stays FROM o)
SELECT CAST(2 AS INT) AS n_features, 'land_size,discount' AS features, round(both_r2, 6) AS r2 FROM m
UNION ALL SELECT 1, CASE WHEN a_stays THEN 'land_size' ELSE 'discount' END, round(CASE WHEN a_stays THEN a_r2 ELSE b_r2 END, 6) FROM m, w""")
def _(t):
    return ml.rfe_cv(training(t), ["land_size", "discount"], "y", "fold", "linear").select("n_features", "features", r("r2"))


@query("M18_gini_top_k_linear", """
WITH o AS (SELECT coalesce(land_size, 0) AS a, coalesce(discount, 0) AS b, ln(unit_price) AS y FROM listings),
g AS (SELECT var_pop(a) AS saa, var_pop(b) AS sbb, covar_pop(a, b) AS sab, covar_pop(a, y) AS say, covar_pop(b, y) AS sby FROM o),
f AS (SELECT 'land_size' AS feature, abs((say * sbb - sby * sab) / (saa * sbb - sab * sab)) AS importance FROM g UNION ALL SELECT 'discount', abs((sby * saa - say * sab) / (saa * sbb - sab * sab)) FROM g)
SELECT CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INT) AS rank, feature, round(importance, 6) AS importance FROM f""")
def _(t):
    model = ml.fit_regressor(training(t), ["land_size", "discount"], "y", "linear")
    return ml.gini_top_k(t.spark, model, ["land_size", "discount"], 2).select("rank", "feature", r("importance"))


SEEDED = "CAST('0x' || substr(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, '{seed}')), 1, 12) AS BIGINT) % 3"


@query("M11_ablation_linear", " UNION ALL ".join(f"""
SELECT * FROM (WITH {fits_sql(SEEDED.format(seed=seed))} SELECT unnest(['baseline', 'none', 'drop_discount']) AS config, CAST({seed} AS BIGINT) AS seed, unnest([round(100 * both_r2, 5), round(100 * a_r2, 5), round(100 * a_r2, 5)]) AS metric FROM m)"""
    for seed in (1, 2)))
def _(t):
    folds_of = lambda df, seed: df.drop("fold").withColumn("fold", (ml.seeded_number(ROW, seed) % 3).cast("int"))
    out = ml.ablation(training(t), ["land_size"], ["discount"], "y", folds_of, [1, 2])
    return out.select("config", "seed", r("metric", 5))


SUMMARY = """p AS (SELECT r.config, r.seed, r.metric, r.metric - b.metric AS delta FROM runs r JOIN runs b ON r.seed = b.seed AND b.config = '1-URGENT'),
m AS (SELECT config, avg(delta) AS md FROM p GROUP BY 1), s AS (SELECT p.config, count(*) AS n_seeds, avg(metric) AS mean, stddev_samp(metric) AS sd, min(metric) AS min, max(metric) AS max, avg(delta) AS delta, stddev_samp(delta) AS delta_sd,
  count(*) FILTER (sign(delta) = sign(md) AND md <> 0) AS same_sign FROM p JOIN m ON p.config = m.config GROUP BY 1)"""


@query("M12_paired_delta_summary", f"""
WITH {SUMMARY} SELECT config, n_seeds, round(mean, 6) AS mean, round(sd, 6) AS sd, round(min, 6) AS min, round(max, 6) AS max, round(delta, 6) AS delta, round(delta_sd, 6) AS delta_sd, same_sign,
  abs(delta) > 2 * delta_sd AND config <> '1-URGENT' AS above_noise, abs(delta) > 2 * delta_sd AND config <> '1-URGENT' AND same_sign = n_seeds AS meets_rule FROM s""")
def _(t):
    out = ml.paired_delta_summary(t.runs, "1-URGENT")
    return out.select("config", "n_seeds", r("mean"), r("sd"), r("min"), r("max"), r("delta"), r("delta_sd"), "same_sign", "above_noise", "meets_rule")


CELLS = "CASE config WHEN '1-URGENT' THEN 'A' WHEN '2-HIGH' THEN 'B' WHEN '3-MEDIUM' THEN 'C' WHEN '5-LOW' THEN 'D' END"


@query("M13_factorial_gaps", f"""
WITH c AS (SELECT {CELLS} AS cell, avg(metric) AS v FROM runs GROUP BY 1), w AS (SELECT max(v) FILTER (cell = 'A') AS a, max(v) FILTER (cell = 'B') AS b, max(v) FILTER (cell = 'C') AS c, max(v) FILTER (cell = 'D') AS d FROM c)
SELECT round(a - b, 6) AS a_minus_b, round(d - c, 6) AS d_minus_c, round(b - c, 6) AS b_minus_c, round(a - d, 6) AS a_minus_d FROM w""")
def _(t):
    c = F.col("config")
    cell = F.when(c == "1-URGENT", "A").when(c == "2-HIGH", "B").when(c == "3-MEDIUM", "C").when(c == "5-LOW", "D")
    out = ml.factorial_gaps(t.runs.groupBy(cell.alias("cell")).agg(F.avg("metric").alias("v")), "cell", "v")
    return out.select(*[r(x) for x in out.columns])


@query("M14_partition_distribution", """
WITH d AS (SELECT o_custkey, avg(o_totalprice) AS m FROM orders GROUP BY 1)
SELECT count(*) AS n, round(avg(m), 4) AS mean, round(stddev_samp(m), 4) AS sd, round(quantile_cont(m, 0.05), 4) AS p05, round(quantile_cont(m, 0.95), 4) AS p95, round(min(m), 4) AS min, round(max(m), 4) AS max,
  round(100 * avg(CASE WHEN m < 250000 THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS reference_percentile FROM d""")
def _(t):
    out = ml.partition_distribution(t.orders.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("m")), "m", 250000.0)
    return out.select("n", *[r(c, 4) for c in ("mean", "sd", "p05", "p95", "min", "max")], r("reference_percentile"))


@query("M15_attribution_ladder", """
WITH g AS (SELECT config AS rung, avg(metric) AS v FROM runs GROUP BY 1) SELECT rung, round(v, 6) AS v, round(v - lag(v) OVER (ORDER BY rung), 6) AS change FROM g""")
def _(t):
    rungs = t.runs.groupBy(F.col("config").alias("rung")).agg(F.avg("metric").alias("v"))
    return ml.attribution_ladder(rungs, "rung", "v").select("rung", r("v"), r("change"))


@query("M16_model_comparison", """
SELECT config, round(max(metric) FILTER (seed = 1995), 6) AS "1995", round(max(metric) FILTER (seed = 1996), 6) AS "1996", round(max(metric) FILTER (seed = 1996) - CASE config WHEN '1-URGENT' THEN 250 WHEN '5-LOW' THEN 245.5 END, 6) AS diff_published FROM runs GROUP BY 1""")
def _(t):
    out = ml.model_comparison(t.runs, "config", "seed", [1995, 1996], "metric", {"1-URGENT": 250.0, "5-LOW": 245.5})
    return out.select("config", r(F.col("`1995`")).alias("1995"), r(F.col("`1996`")).alias("1996"), r("diff_published"))


def small_forest(t):
    data = training(t)
    return data, ml.fit_regressor(data.filter("fold <> 0"), FEATURES, "y", "forest", numTrees=5, maxDepth=4)


@query("M17_permutation_importance")
def _(t):
    data, model = small_forest(t)
    return ml.permutation_importance(model, data.filter("fold = 0"), ROW, FEATURES, "y", 2)


@query("M18_gini_top_k")
def _(t):
    _data, model = small_forest(t)
    return ml.gini_top_k(t.spark, model, FEATURES, 3)


def attributions(t):
    data, model = small_forest(t)
    units = data.groupBy("division").agg(*[F.avg(c).alias(c) for c in FEATURES])
    return ml.shapley_sample(model, units, ["division"], FEATURES, 6)


@query("M19_shapley_sample")
def _(t):
    return attributions(t)


@query("M19_tree_attributions")
def _(t):
    data, model = small_forest(t)
    return tree_attributions(model, data, ROW, FEATURES)


PHI = """a AS (SELECT land_type AS feature, discount AS value, (discount - CAST(0.05 AS DOUBLE)) * (CASE land_type WHEN 'A_F' THEN 2 WHEN 'N_O' THEN -1 ELSE CAST(0.5 AS DOUBLE) END) + tax / 10 AS phi FROM listings)"""


def phi_table(t):
    k = F.when(F.col("land_type") == "A_F", 2.0).when(F.col("land_type") == "N_O", -1.0).otherwise(0.5)
    return t.listings.select(F.col("land_type").alias("feature"), F.col("discount").alias("value"), ((F.col("discount") - 0.05) * k + F.col("tax") / 10).alias("phi"))


@query("M20_attribution_summary", f"""
WITH {PHI}, p AS (SELECT feature, avg(abs(phi)) AS m, avg(phi) AS mp, corr(value, phi) AS d FROM a GROUP BY 1)
SELECT feature, round(m, 6) AS mean_abs_phi, CAST(rank() OVER (ORDER BY m DESC) AS BIGINT) AS rank, round(100 * m / sum(m) OVER (), 6) AS share_pct, CASE feature WHEN 'A_F' THEN 'land' WHEN 'A_O' THEN 'land' ELSE 'other' END AS block,
  round(d, 6) AS direction, round(100 * (exp(mp) - 1), 6) AS effect_pct FROM p""")
def _(t):
    out = ml.attribution_summary(phi_table(t), {"A_F": "land", "A_O": "land"})
    return out.select("feature", r("mean_abs_phi"), "rank", r("share_pct"), "block", r("direction"), r("effect_pct"))


@query("M20_attribution_direction", f"""
WITH {PHI}, f AS (SELECT * FROM a WHERE feature = 'A_F'), k AS (SELECT rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / CAST(2 AS DOUBLE) AS rx, rank() OVER (ORDER BY phi) + (count(*) OVER (PARTITION BY phi) - 1) / CAST(2 AS DOUBLE) AS ry FROM f)
SELECT count(*) AS n, round(corr(rx, ry), 5) AS rho FROM k""")
def _(t):
    return ml.attribution_direction(phi_table(t), "A_F").select("n", r("rho", 5))


@query("M21_waterfall_steps", f"""
WITH {PHI}, g AS (SELECT feature, avg(phi) AS phi FROM a GROUP BY 1), w AS (SELECT feature, phi, row_number() OVER (ORDER BY feature) AS step, 7.5 + sum(phi) OVER (ORDER BY feature) AS e FROM g)
SELECT feature, CAST(step AS INT) AS step, round(e - phi, 6) AS start, round(e, 6) AS "end" FROM w""")
def _(t):
    grouped = phi_table(t).groupBy("feature").agg(F.avg("phi").alias("phi")).withColumn("case", F.lit("A"))
    out = ml.waterfall_steps(grouped, ["case"], F.col("feature"), "phi", F.lit(7.5))
    return out.select("feature", "step", r("start"), r("end"))


@query("M22_residuals", f"""
WITH {SCORED}, v AS (SELECT y - p AS x FROM s), e AS (SELECT min(x) AS lo, max(x) AS hi, (max(x) - min(x)) / 15 AS w FROM v), c AS (SELECT CAST(least(floor((x - lo) / w), 14) AS BIGINT) AS bin, count(*) AS n FROM v, e GROUP BY 1)
SELECT b.bin, round(lo + b.bin * w, 6) AS left_edge, round(lo + (b.bin + 1) * w, 6) AS right_edge, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, 15)) AS bin) b CROSS JOIN e LEFT JOIN c ON b.bin = c.bin""")
def _(t):
    out = aggregates.histogram(ml.residuals(scored(t), "y", "p"), "residual", 15)
    return out.select("bin", r("left_edge"), r("right_edge"), "n")


@query("M23_reproduction_gate", """
WITH a AS (SELECT division, avg(unit_price) AS v FROM listings GROUP BY 1), b AS (SELECT division, avg(unit_price) + CASE WHEN division % 7 = 0 THEN 0.5 ELSE 0 END AS v FROM listings GROUP BY 1),
j AS (SELECT max(abs(a.v - b.v)) AS d, count(*) FILTER (a.v IS NULL OR b.v IS NULL) AS m FROM a FULL JOIN b ON a.division = b.division),
k AS (SELECT count(*) AS n FROM (SELECT division FROM a ORDER BY v DESC, division LIMIT 10) x JOIN (SELECT division FROM b ORDER BY v DESC, division LIMIT 10) y USING (division))
SELECT 'reproduction' AS "check", d <= 0.1 AND m = 0 AS ok, round(d, 6) AS max_abs_diff, m AS missing, k.n AS top_k_agree FROM j, k""")
def _(t):
    a = t.listings.groupBy("division").agg(F.avg("unit_price").alias("v"))
    b = a.withColumn("v", F.col("v") + F.when(F.col("division") % 7 == 0, 0.5).otherwise(0.0))
    return ml.reproduction_gate(a, b, "division", "v", 0.1).select("check", "ok", r("max_abs_diff"), "missing", "top_k_agree")
