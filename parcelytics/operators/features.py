"""Feature engineering, leak-safe encoding and feature screening."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelytics import fixed_values as fv
from parcelytics.functions import numeric
from parcelytics.operators.aggregates import correlation
from parcelytics.plans.scale import attach_scalar, attach_stats, exact_quantiles, maybe_broadcast, null_safe_join, stack_rows, with_value_rank


def row_aggregates(df: DataFrame, subtotals: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """total_amenity_count over count_* (NULL as 0), min_dist_any_amenity over min_dist* (NULL skipped), subtotals."""
    counts = [c for c in df.columns if c.startswith("count_")]
    dists = [c for c in df.columns if c.startswith("min_dist")]
    out = df.withColumn("total_amenity_count", numeric.sum_skip_null([F.col(f"`{c}`") for c in counts]))
    nearest = F.least(*[F.col(f"`{c}`") for c in dists]) if len(dists) > 1 else F.col(f"`{dists[0]}`")
    out = out.withColumn("min_dist_any_amenity", nearest)
    for name, parts in (subtotals or {}).items():
        out = out.withColumn(name, sum((F.col(f"`{c}`") for c in parts), F.lit(0)))
    return out


def density(count: Column, distance: Column) -> Column:
    return count / (distance + 0.1)


def interaction_features(df: DataFrame, group: str, ratio: tuple[str, str], product: tuple[str, str], filled: str,
                         signed: dict[str, int]) -> DataFrame:
    """Density, product, group frequency, median-filled column, and a signed sum of z-scores (sample sd + 1e-9)."""
    out = df.withColumn("density", density(F.col(ratio[0]), F.col(ratio[1])))
    out = out.withColumn("product", F.col(product[0]) * F.col(product[1]))
    out = attach_stats(out, [group], F.count("*").alias("group_freq"))
    out = attach_scalar(out, exact_quantiles(df, [], filled, {"__median": 0.5})).withColumn(
        f"{filled}_filled", F.coalesce(F.col(filled), F.col("__median"))).drop("__median")
    stats = df.agg(*[F.avg(c).alias(f"__m_{c}") for c in signed], *[F.stddev_samp(c).alias(f"__s_{c}") for c in signed])
    out = attach_scalar(out, stats)
    score = sum((sign * (F.col(c) - F.col(f"__m_{c}")) / (F.col(f"__s_{c}") + 1e-9) for c, sign in signed.items()), F.lit(0.0))
    return out.withColumn("risk_score", score).drop(*stats.columns)


def clean_name(name: str) -> str:
    """Anything but letters, digits and underscore becomes one underscore."""
    import re

    return re.sub(r"[^0-9a-zA-Z_]+", "_", name)


def one_hot(df: DataFrame, col: str, categories: Sequence[str], prefix: str | None = None) -> DataFrame:
    """0/1 columns in sorted category order with sanitised names; NULL gives all zeros."""
    prefix = prefix or col
    return df.select("*", *[
        F.coalesce((F.col(col) == v).cast("int"), F.lit(0)).alias(clean_name(f"{prefix}_{v}")) for v in sorted(categories)])


def categories_of(df: DataFrame, col: str, limit: int = 10_000) -> list[str]:
    """Sorted distinct values of a category column; refuses a column that is not categorical."""
    found = [r[0] for r in df.select(col).filter(F.col(col).isNotNull()).distinct().limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"{col} has more than {limit} values")
    return sorted(found)


def target_encode_oof(df: DataFrame, group: str, target: str, fold: str, m: float = fv.ENCODING_SMOOTHING,
                      name: str = "target_enc") -> DataFrame:
    """Out-of-fold smoothed mean: a row is encoded from the other folds only; unseen groups get the overall mean.

    Group totals minus own-fold totals, from one pre-aggregated table of (group, fold) sums.
    """
    cells = df.groupBy(group, fold).agg(F.sum(target).alias("__s"), F.count(target).alias("__c"))
    totals = attach_stats(cells, [group], F.sum("__s").alias("__gs"), F.sum("__c").alias("__gc"))
    overall = attach_scalar(totals, cells.agg((F.sum("__s") / F.sum("__c")).alias("__mean")))
    rest_n = F.col("__gc") - F.col("__c")
    encoded = F.when(rest_n == 0, F.col("__mean")).otherwise((F.col("__gs") - F.col("__s") + m * F.col("__mean")) / (rest_n + m))
    return null_safe_join(df, overall.select(group, fold, encoded.alias(name)), [group, fold], "left")


def target_encoding(train: DataFrame, group: str, target: str, m: float = fv.ENCODING_SMOOTHING, name: str = "target_enc") -> DataFrame:
    """Serving table: group and (sum + m * mean) / (n + m) over all training rows."""
    sums = train.groupBy(group).agg(F.sum(target).alias("__s"), F.count(target).alias("__c"))
    mean = sums.agg((F.sum("__s") / F.sum("__c")).alias("__mean"))
    return attach_scalar(sums, mean).select(group, ((F.col("__s") + m * F.col("__mean")) / (F.col("__c") + m)).alias(name), "__mean")


def apply_target_encoding(test: DataFrame, encoding: DataFrame, group: str, name: str = "target_enc") -> DataFrame:
    """Left join; unseen groups get the training mean and are marked."""
    mean = encoding.agg(F.max("__mean").alias("__fill"))
    joined = test.join(maybe_broadcast(encoding.select(group, name)), group, "left")
    return attach_scalar(joined, mean).withColumn("unseen", F.col(name).isNull()).withColumn(
        name, F.coalesce(F.col(name), F.col("__fill"))).drop("__fill")


def ordered_features(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """The named columns in order as doubles; a missing column or value is 0."""
    return [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(c) if c in df.columns else F.lit(0.0).alias(c) for c in columns]


def assemble(df: DataFrame, columns: Sequence[str], output: str = "features", keep: Sequence[str] = ()) -> DataFrame:
    """Strictly ordered dense feature vector next to the kept columns."""
    shaped = df.select(*[F.col(k).alias(f"__keep_{k}") for k in keep], *ordered_features(df, columns))
    out = VectorAssembler(inputCols=list(columns), outputCol=output).transform(shaped)
    return out.select(*[F.col(f"__keep_{k}").alias(k) for k in keep], output)


def standardize(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """z-scores with the population sd of the fitted rows; constant columns become 0."""
    fit_on = df if fit_on is None else fit_on
    stats = fit_on.agg(*[F.avg(c).alias(f"__m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"__s_{c}") for c in columns])
    out = attach_scalar(df, stats)
    for c in columns:
        out = out.withColumn(c, F.when(F.col(f"__s_{c}") == 0, F.lit(0.0)).otherwise((F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")))
    return out.drop(*stats.columns)


def screen_features(df: DataFrame, candidates: Sequence[str], anchor: str, rejected: dict[str, str] | None = None,
                    distinct_min: int = fv.DISTINCT_MIN, r_max: float = fv.R_MAX) -> DataFrame:
    """KEEP, DROP or REJECT per candidate with nulls, distinct values, range, mean and correlation with the anchor."""
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(candidates):
        aggs += [F.count(c).alias(f"n{i}"), F.min(c).cast("double").alias(f"lo{i}"),
                 F.max(c).cast("double").alias(f"hi{i}"), F.avg(c).alias(f"av{i}"), correlation(F.col(c), F.col(anchor)).alias(f"r{i}")]
    # distinct (column, value) pairs combine in the map tasks; distinct counts in one aggregate would copy every row per column
    pairs = stack_rows(df, [(F.lit(i), F.col(c).cast("double")) for i, c in enumerate(candidates)], ["i", "v"]).filter("v IS NOT NULL").distinct()
    distinct = pairs.groupBy().agg(*[F.count_if(F.col("i") == i).alias(f"d{i}") for i in range(len(candidates))])
    stats = attach_scalar(df.agg(*aggs), distinct)
    rows = []
    for i, c in enumerate(candidates):
        verdict = (
            F.when(F.lit(c in (rejected or {})), "REJECT").when(F.col(f"d{i}") < distinct_min, "DROP")
            .when(F.abs(f"r{i}") > r_max, "DROP").otherwise("KEEP"))
        why = (
            F.when(F.lit(c in (rejected or {})), F.lit((rejected or {}).get(c, ""))).when(F.col(f"d{i}") < distinct_min, "too few distinct values")
            .when(F.abs(f"r{i}") > r_max, "restates the anchor").otherwise("passes"))
        rows.append((F.lit(c), F.col("rows") - F.col(f"n{i}"), F.col(f"d{i}"), F.col(f"lo{i}"), F.col(f"hi{i}"), F.col(f"av{i}"), F.col(f"r{i}"), verdict, why))
    return stack_rows(stats, rows, ["feature", "nulls", "distinct", "min", "max", "mean", "r_anchor", "verdict", "reason"])


def resolve_collinear(pairs: DataFrame, keep: Sequence[str], prefer: Sequence[str], existing: Sequence[str] = (),
                      flag_only: Sequence[tuple[str, str]] = (), r_max: float = fv.R_MAX) -> DataFrame:
    """Greedy elimination over correlated pairs (a, b, r): strongest first, an existing column beats a new one, then
    the preference order; pairs of existing columns and flag-only pairs are only flagged.

    The pair list has one row per pair of candidate columns; the greedy pass over it runs on the driver.
    """
    alive, rows = set(keep), []
    strong = pairs.filter(F.abs("r") > r_max).orderBy(F.abs("r").desc(), "a", "b").collect()
    frozen = {frozenset(p) for p in flag_only}
    place = {name: i for i, name in enumerate(prefer)}
    for a, b, r in ((row["a"], row["b"], row["r"]) for row in strong):
        if a not in alive or b not in alive:
            continue
        if frozenset((a, b)) in frozen or (a in existing and b in existing):
            rows.append((a, b, float(r), "flagged", None))
            continue
        if (a in existing) != (b in existing):
            loser = b if a in existing else a
        else:
            loser = b if place.get(a, len(place)) <= place.get(b, len(place)) else a
        alive.discard(loser)
        rows.append((a, b, float(r), "dropped", loser))
    return pairs.sparkSession.createDataFrame(rows, "a string, b string, r double, action string, loser string")


def physical_consistency(df: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """Sign, strength and range of each variable against its reference column: `ref, sign, r_min, lo, hi`."""
    aggs = []
    for i, (c, rule) in enumerate(rules.items()):
        aggs += [correlation(F.col(c), F.col(rule["ref"])).alias(f"r{i}"), F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")]
    rows = []
    for i, (c, rule) in enumerate(rules.items()):
        good = (F.signum(f"r{i}") == rule["sign"]) & (F.abs(f"r{i}") >= rule["r_min"])
        inside = (F.col(f"lo{i}") >= rule["lo"]) & (F.col(f"hi{i}") <= rule["hi"])
        rows.append((F.lit(c), F.col(f"r{i}"), F.col(f"lo{i}").cast("double"), F.col(f"hi{i}").cast("double"), F.coalesce(good, F.lit(False)), inside,
                     F.coalesce(good & inside, F.lit(False))))
    return stack_rows(df.agg(*aggs), rows, ["variable", "r", "min", "max", "agrees", "in_range", "passes"])


def group_rank_test(df: DataFrame, unit: str, value: str, role: Column) -> DataFrame:
    """Mean descending rank (ties share the best) of the expected-high, expected-low and control groups and the verdicts.

    Separation passes when high ranks before low; the control fails when it ranks before high.
    """
    ranked = with_value_rank(df.select(unit, value, role.alias("__role")), [], value, True, "__r")
    mean = lambda label: F.avg(F.when(F.col("__role") == label, F.col("__r_min")))
    return ranked.agg(F.count(value).alias("n"), mean("high").alias("high_rank"), mean("low").alias("low_rank"), mean("control").alias("control_rank")).select(
        "*", F.when(F.col("high_rank") < F.col("low_rank"), "PASS").otherwise("FAIL").alias("separation"),
        F.when(F.col("control_rank") < F.col("high_rank"), "FAIL").otherwise("PASS").alias("control"))


def sensitivity_flip(df: DataFrame, base: str, alternative: str, reference: str, threshold: float) -> DataFrame:
    """Does |r| with the reference cross the threshold under the alternative extraction but not the base, or back?"""
    stats = df.agg(correlation(F.col(base), F.col(reference)).alias("r_base"), correlation(F.col(alternative), F.col(reference)).alias("r_alternative"))
    passes = lambda c: F.abs(F.col(c)) <= threshold
    return stats.select("*", passes("r_base").alias("base_passes"), passes("r_alternative").alias("alternative_passes"),
                        (passes("r_base") != passes("r_alternative")).alias("flips"))


def join_survivors(facts: DataFrame, features: DataFrame, key: str, survivors: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(joined, null counts): carry every surviving column to the facts and report what stayed NULL."""
    joined = facts.join(maybe_broadcast(features.select(key, *survivors)), key, "left")
    stats = joined.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in survivors])
    return joined, stack_rows(stats, [(F.lit(c), F.col(c), F.col("rows")) for c in survivors], ["feature", "nulls", "rows"])


def compare_extractions(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Agreement of two extractions of one variable: units, correlation, mean absolute difference."""
    joined = a.select(key, F.col(value).alias("__a")).join(b.select(key, F.col(value).alias("__b")), key)
    return joined.agg(F.count("*").alias("n"), correlation(F.col("__a"), F.col("__b")).alias("r"), F.avg(F.abs(F.col("__a") - F.col("__b"))).alias("mean_abs_diff"))
