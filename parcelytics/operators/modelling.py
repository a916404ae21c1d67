"""Splits, folds, training, scoring metrics, ablation statistics and attributions."""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable, Iterable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelytics.operators import features as ft
from parcelytics.operators import forest
from parcelytics.operators.aggregates import correlation, spearman
from parcelytics.operators.boosting import SecondOrderBooster
from parcelytics.plans.scale import attach_scalar, attach_stats, exact_quantiles, is_small, maybe_broadcast, reads_plainly, with_positions, with_value_rank
from parcelytics.session import freeze

BUCKETS = 1_000_000

#: Bytes read up to which a fit works its rows out anew on every pass; larger inputs are written once.
FIT_BYTES = 32 * 1024 * 1024


# --------------------------------------------------------------------------- splits and folds
def seeded_number(keys: Sequence[str], seed: int) -> Column:
    """A number below 2^48 from the md5 of the keys and the seed, which any engine with md5 can repeat."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts, F.lit(str(seed)))), 1, 12), 16, 10).cast("long")


def random_split(df: DataFrame, keys: Sequence[str], test_share: float, seed: int, name: str = "is_test") -> DataFrame:
    """Mark test rows by a hash of the key and the seed: independent of partitioning and stable over re-runs."""
    bucket = seeded_number(keys, seed) % BUCKETS
    return df.withColumn(name, bucket < int(round(test_share * BUCKETS)))


def source_aware_split(df: DataFrame, keys: Sequence[str], synthetic: Column, test_share: float, seed: int, name: str = "is_test") -> DataFrame:
    """Synthetic rows never enter the test part."""
    return random_split(df, keys, test_share, seed, name).withColumn(name, F.col(name) & ~synthetic)


def balance_plan(size_classes: Sequence[tuple[int, int]], k: int) -> list[tuple[int, int, int, list[int]]]:
    """Largest-first assignment to the lightest fold, described per size class instead of per group.

    Input: (size, groups of that size), largest size first. Output rows: (size, first position, number of positions,
    fold cycle): the i-th group of the segment goes to cycle[i % len(cycle)]. Groups of one size differ only by
    position, so the lightest folds take turns until they level with the others; a class needs about 2k segments
    however many groups it has.
    """
    loads, plan = [0] * k, []
    for size, count in size_classes:
        start = 0
        while start < count:
            left, low = count - start, min(loads)
            if max(loads) - low < size:  # every fold takes one in turn, and the pattern repeats
                cycle, take = sorted(range(k), key=lambda f: (loads[f], f)), left
            else:
                cycle = [f for f in range(k) if loads[f] == low]
                above = min(x for x in loads if x > low)
                take = min(left, -(-(above - low) // size) * len(cycle))
            plan.append((size, start, take, cycle))
            for i, fold in enumerate(cycle):
                loads[fold] += size * (take // len(cycle) + (1 if i < take % len(cycle) else 0))
            start += take
    return plan


def group_folds(df: DataFrame, group: str, k: int, tie: Column | None = None, name: str = "fold") -> DataFrame:
    """Balanced group folds: groups walk from largest to smallest, each to the fold with the fewest rows so far.

    Groups of equal size go in key order (or `tie` order). Only the distinct sizes (at most about sqrt(2 * rows)) reach
    the driver; groups are placed by their position among those of the same size. Returns group, n, fold.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    classes = [(r["n"], r["c"]) for r in sizes.groupBy("n").agg(F.count("*").alias("c")).orderBy(F.col("n").desc()).collect()]
    plan = df.sparkSession.createDataFrame(
        balance_plan(classes, k), "n long, start long, take long, cycle array<int>")
    order = [F.col(group)] if tie is None else [tie, F.col(group)]
    placed = with_positions(sizes, ["n"], order, "__p").withColumn("__p", F.col("__p") - 1)
    joined = placed.join(maybe_broadcast(plan), "n").filter((F.col("__p") >= F.col("start")) & (F.col("__p") < F.col("start") + F.col("take")))
    fold = F.element_at("cycle", ((F.col("__p") - F.col("start")) % F.size("cycle") + 1).cast("int"))
    return joined.select(group, "n", fold.alias(name))


def shuffled_group_folds(df: DataFrame, group: str, k: int, seed: int, name: str = "fold") -> DataFrame:
    """As `group_folds`, with equal sizes walked in a seeded random order."""
    return group_folds(df, group, k, seeded_number([group], seed), name)


# --------------------------------------------------------------------------- training
def regressor(kind: str, **params):
    """'forest', 'boosted', 'second_order' (boosted with curvature, shrinkage and L2) or 'linear' on columns features and label."""
    common = {"featuresCol": "features", "labelCol": "label", "predictionCol": "prediction"}
    if kind == "forest":
        return RandomForestRegressor(**common, **{"featureSubsetStrategy": "all", "seed": 42, **params})
    if kind == "boosted":
        return GBTRegressor(**common, **{"seed": 42, **params})
    if kind == "linear":
        return LinearRegression(**common, **params)
    if kind == "second_order":
        return SecondOrderBooster(**params)
    raise ValueError(f"unknown regressor {kind}")


def settled(df: DataFrame, columns: Sequence[str], limit: int | None = None) -> DataFrame:
    """The named columns of a large input, written once: every fit and every score of a loop reads them again."""
    return df if is_small(df, limit) else freeze(df.select(*dict.fromkeys(c for c in columns if c in df.columns)))


def grows_together(df: DataFrame, kind: str, params: Iterable[str]) -> bool:
    """True for forests of a large input with no other settings than number and depth of the trees."""
    return kind == "forest" and set(params) <= {"numTrees", "maxDepth"} and not is_small(df, FIT_BYTES)


def fit_regressor(train: DataFrame, columns: Sequence[str], target: str, kind: str = "forest", **params):
    """Fit on the ordered features; the model scores tables made by `features.assemble`."""
    shaped = ft.assemble(train.withColumn("label", F.col(target)), columns, keep=["label"])
    return regressor(kind, **params).fit(shaped)


def fit_and_score(df: DataFrame, held_out: str, columns: Sequence[str], target: str, models: dict[str, tuple[str, dict]]) -> DataFrame:
    """Metrics per model (name: kind and settings), each fitted on the rows not held out and scored on the others; column model.

    A fit reads its rows at every level of every tree and the exact median reads the scores some times. The rows of a large input
    are written before the first fit, the scores before their median, so that neither the features nor the split are worked out again.
    """
    large = not is_small(df, FIT_BYTES)
    data, out = settled(df, [*columns, target, held_out], FIT_BYTES), None
    for name, (kind, params) in models.items():
        model = fit_regressor(data.filter(~F.col(held_out)), columns, target, kind, **params)
        scores = predict(model, data.filter(held_out), columns).select(target, "prediction")
        row = metrics(freeze(scores) if large else scores, target, "prediction").withColumn("model", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def predict(model, df: DataFrame, columns: Sequence[str], name: str = "prediction") -> DataFrame:
    """Add the model's prediction; missing features count as 0."""
    shaped = df.select("*", F.struct(*ft.ordered_features(df, columns)).alias("__f"))
    flat = shaped.select(*df.columns, *[F.col(f"__f.`{c}`").alias(f"__x{i}") for i, c in enumerate(columns)])
    vectors = VectorAssembler(inputCols=[f"__x{i}" for i in range(len(columns))], outputCol="features").transform(flat)
    return model.transform(vectors).select(*df.columns, F.col("prediction").alias(name))


def random_search_cv(train: DataFrame, columns: Sequence[str], target: str, fold: str, kind: str, space: dict[str, Sequence],
                     n: int, k: int, seed: int = 42, parallelism: int = 4) -> DataFrame:
    """n sampled settings, k folds from the fold column, mean R2 per setting, best first.

    Forests of a large input grow together, all settings and folds at once (`forest`), where their cells fit a task.
    """
    names = sorted(space)
    grid = list(itertools.product(*[space[p] for p in names]))
    drawn = random.Random(seed).sample(grid, min(n, len(grid)))
    estimator = regressor(kind)
    if grows_together(train, kind, names):
        train = train if reads_plainly(train) else settled(train, [*columns, target, fold], FIT_BYTES)
        settings = [(found.get("numTrees", 20), found.get("maxDepth", 5)) for found in (dict(zip(names, values)) for values in drawn)]
        most = [max(one) for one in zip(*settings)]
        found = forest.grown(train.withColumn(fold, F.col(fold).cast("int")), columns, target, fold, None, range(k), *most, settings=settings, only=True)
        if found:
            rows = [(str(dict(zip(names, values))), sum(r2) / k) for values, r2 in zip(drawn, found[2])]
            return train.sparkSession.createDataFrame(rows, "params string, mean_r2 double").orderBy(F.col("mean_r2").desc())
    if not is_small(train):  # models trained side by side would hold their inputs in memory at the same time
        train, parallelism = settled(train, [*columns, target, fold]), 1
    maps = [{getattr(estimator, p): v for p, v in zip(names, values)} for values in drawn]
    shaped = ft.assemble(train.withColumn("label", F.col(target)).withColumn("fold", F.col(fold).cast("int")), columns, keep=["label", "fold"])
    search = CrossValidator(estimator=estimator, estimatorParamMaps=maps, evaluator=RegressionEvaluator(metricName="r2", labelCol="label"),
                            numFolds=k, foldCol="fold", parallelism=parallelism, seed=seed)
    result = search.fit(shaped)
    rows = [(str(dict(zip(names, values))), float(score)) for values, score in zip(drawn, result.avgMetrics)]
    return train.sparkSession.createDataFrame(rows, "params string, mean_r2 double").orderBy(F.col("mean_r2").desc())


def rfe_cv(train: DataFrame, columns: Sequence[str], target: str, fold: str, kind: str = "forest", step: int = 1, minimum: int = 1, **params) -> DataFrame:
    """Recursive elimination: cross-validated R2 of each shrinking feature set; the least important go first."""
    current, rows = list(columns), []
    train = settled(train, [*columns, target, fold])
    while True:
        scored = _cross_validate(train, current, target, fold, kind=kind, median=False, **params).filter("fold = 'mean'").first()
        rows.append((len(current), ",".join(current), float(scored["r2"])))
        if len(current) <= minimum:
            break
        importance = gini_importances(fit_regressor(train, current, target, kind, **params), current)
        order = sorted(importance, key=lambda item: item[1])
        gone = {name for name, _ in order[: min(step, len(current) - minimum)]}
        current = [c for c in current if c not in gone]
    return train.sparkSession.createDataFrame(rows, "n_features int, features string, r2 double").orderBy(F.col("r2").desc())


def gini_importances(model, columns: Sequence[str]) -> list[tuple[str, float]]:
    values = model.featureImportances.toArray() if hasattr(model, "featureImportances") else abs(model.coefficients.toArray())
    return [(name, float(v)) for name, v in zip(columns, values)]


def gini_top_k(spark, model, columns: Sequence[str], k: int) -> DataFrame:
    """Impurity importances, largest first."""
    rows = sorted(gini_importances(model, columns), key=lambda item: (-item[1], item[0]))[:k]
    return spark.createDataFrame([(i + 1, name, v) for i, (name, v) in enumerate(rows)], "rank int, feature string, importance double")


def ensemble_mean(predictions: Sequence[DataFrame], key: Sequence[str], column: str, name: str = "prediction") -> DataFrame:
    """Average of several models' predictions (log scale) joined on the row key."""
    out = predictions[0].select(*key, F.col(column).alias("__p0"))
    for i, more in enumerate(predictions[1:], 1):
        out = out.join(more.select(*key, F.col(column).alias(f"__p{i}")), list(key))
    total = sum((F.col(f"__p{i}") for i in range(1, len(predictions))), F.col("__p0"))
    return out.select(*key, (total / len(predictions)).alias(name))


# --------------------------------------------------------------------------- metrics
def metrics(df: DataFrame, y: str, p: str, keys: Sequence[str] = (), median: bool = True) -> DataFrame:
    """n, R2, RMSE and MAE on the log scale; MAE, MAPE and median APE after exp. One pass plus the exact median (if wanted)."""
    scored = df.select(*keys, F.col(y).alias("__y"), F.col(p).alias("__p")).withColumn("__e", F.col("__y") - F.col("__p")).withColumn(
        "__re", F.abs(F.exp("__y") - F.exp("__p"))).withColumn("__ape", 100 * F.col("__re") / F.exp("__y"))
    basic = [
        F.count("*").alias("n"),
        (1 - F.sum(F.col("__e") * F.col("__e")) / F.nullif(F.var_pop("__y") * F.count("__y"), F.lit(0.0))).alias("r2"),
        F.sqrt(F.avg(F.col("__e") * F.col("__e"))).alias("rmse_log"), F.avg(F.abs("__e")).alias("mae_log"),
        F.avg("__re").alias("mae"), F.avg("__ape").alias("mape"),
    ]
    return exact_quantiles(scored, keys, "__ape", {"median_ape": 0.5}, also=basic) if median else scored.groupBy(*keys).agg(*basic)


def cross_validate(df: DataFrame, columns: Sequence[str], target: str, fold: str, group: str | None = None, kind: str = "forest",
                   folds: Sequence[int] | None = None, parallelism: int = 4, **params) -> DataFrame:
    """Leak-safe CV: in every fold the encoder is fitted on the training part only; one row per fold and a mean row.

    With `group`, training rows get an out-of-fold encoding over the remaining folds and validation rows the encoding
    of the whole training part. Folds run side by side on one session, those of a large input one after the other: there a fit
    uses all cores, and the inputs of several would not fit into memory together. Forests of a large input grow together (`forest`).
    """
    if grows_together(df, kind, params):
        df = df if reads_plainly(df) else settled(df, [*columns, target, fold, *([group] if group else [])], FIT_BYTES)
        found = forest.grown(df, columns, target, fold, group, folds, params.get("numTrees", 20), params.get("maxDepth", 5))
        if found:
            scored = metrics(freeze(forest.scores(*found[:2])), "label", "prediction", ["held"])
            return with_mean(scored.select(*[c for c in scored.columns if c != "held"], F.col("held").alias("fold")))
    return _cross_validate(settled(df, [*columns, target, fold, *([group] if group else [])]), columns, target, fold, group, kind, folds, parallelism, **params)


def _cross_validate(df: DataFrame, columns: Sequence[str], target: str, fold: str, group: str | None = None, kind: str = "forest",
                    folds: Sequence[int] | None = None, parallelism: int = 4, median: bool = True, **params) -> DataFrame:
    """`cross_validate` of settled rows; without `median` the median APE is left out."""
    small = is_small(df)
    if folds is None:
        folds = [r[0] for r in df.select(fold).distinct().orderBy(fold).limit(1001).collect()]
        if len(folds) > 1000:
            raise ValueError(f"{fold} is not a fold column: more than 1000 values")

    def run(held_out: int) -> DataFrame:
        train, test = df.filter(F.col(fold) != held_out), df.filter(F.col(fold) == held_out)
        used = list(columns)
        if group:
            test = ft.apply_target_encoding(test, ft.target_encoding(train, group, target), group)
            train = ft.target_encode_oof(train, group, target, fold)
            used.append("target_enc")
        if group and not small:  # a fit reads its rows several times
            train = settled(train, [*used, target])
        model = fit_regressor(train, used, target, kind, **params)
        scored = predict(model, test, used)
        if median and not small:  # so do the medians
            scored = freeze(scored.select(target, "prediction"))
        return metrics(scored, target, "prediction", median=median).withColumn("fold", F.lit(str(held_out)))

    with ThreadPool(min(parallelism if small else 1, len(folds))) as pool:
        parts = pool.map(run, folds)
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return with_mean(rows)


def with_mean(rows: DataFrame) -> DataFrame:
    """The metrics of the folds and their mean."""
    names = [c for c in rows.columns if c not in ("fold", "n")]
    mean = rows.agg(F.sum("n").alias("n"), *[F.avg(c).alias(c) for c in names]).withColumn("fold", F.lit("mean"))
    return rows.unionByName(mean)


def ablation(df: DataFrame, base: Sequence[str], block: Sequence[str], target: str, folds_of: Callable[[DataFrame, int], DataFrame], seeds: Sequence[int],
             group: str | None = None, kind: str = "linear", drop_one: bool = True, **params) -> DataFrame:
    """Run table (config, seed, metric): all block columns, none, and each one left out, over seeded folds.

    `folds_of(df, seed)` adds the fold column of one replicate.
    """
    configs = {"baseline": list(block), "none": []}
    if drop_one:
        configs.update({f"drop_{c}": [x for x in block if x != c] for c in block})
    out = None
    for seed in seeds:
        with_fold = settled(folds_of(df, seed), [*base, *block, target, "fold", *([group] if group else [])])
        for config, extra in configs.items():
            scored = _cross_validate(with_fold, [*base, *extra], target, "fold", group, kind, median=False, **params).filter("fold = 'mean'")
            row = scored.select(F.lit(config).alias("config"), F.lit(seed).cast("long").alias("seed"), (100 * F.col("r2")).alias("metric"))
            out = row if out is None else out.unionByName(row)
    return out


def paired_delta_summary(runs: DataFrame, baseline: str) -> DataFrame:
    """Per config: mean and spread of the metric, paired difference to the baseline on the same seed, and both verdicts.

    `above_noise`: |mean difference| > 2 sd. `meets_rule`: that, and every seed moves the same way as the mean.
    """
    base = runs.filter(F.col("config") == baseline).select("seed", F.col("metric").alias("__b"))
    paired = runs.join(base, "seed", "left").withColumn("delta", F.col("metric") - F.col("__b"))
    stats = attach_stats(paired, ["config"], F.avg("delta").alias("__mean"))
    same = F.count_if((F.signum("delta") == F.signum("__mean")) & (F.col("__mean") != 0))
    out = stats.groupBy("config").agg(
        F.count("*").alias("n_seeds"), F.avg("metric").alias("mean"), F.stddev_samp("metric").alias("sd"), F.min("metric").alias("min"), F.max("metric").alias("max"),
        F.avg("delta").alias("delta"), F.stddev_samp("delta").alias("delta_sd"), same.alias("same_sign"))
    noise = F.coalesce(F.abs("delta") > 2 * F.col("delta_sd"), F.lit(False)) & (F.col("config") != baseline)
    return out.withColumn("above_noise", noise).withColumn("meets_rule", noise & (F.col("same_sign") == F.col("n_seeds")))


def factorial_gaps(cells: DataFrame, cell: str, value: str) -> DataFrame:
    """2 x 2 effects from cells A, B, C, D: A-B, D-C, B-C and A-D."""
    at = lambda name: F.max(F.when(F.col(cell) == name, F.col(value)))
    return cells.agg(*[at(n).alias(n.lower()) for n in "ABCD"]).select(
        (F.col("a") - F.col("b")).alias("a_minus_b"), (F.col("d") - F.col("c")).alias("d_minus_c"),
        (F.col("b") - F.col("c")).alias("b_minus_c"), (F.col("a") - F.col("d")).alias("a_minus_d"))


def partition_distribution(runs: DataFrame, metric: str, reference: float | Column) -> DataFrame:
    """Spread of a metric over partitions and the percentile of the deterministic run in it."""
    ref = reference if isinstance(reference, Column) else F.lit(float(reference))
    basic = runs.withColumn("__ref", ref).agg(
        F.count("*").alias("n"), F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("sd"), F.min(metric).alias("min"), F.max(metric).alias("max"),
        (100 * F.avg((F.col(metric) < F.col("__ref")).cast("double"))).alias("reference_percentile"))
    return attach_scalar(basic, exact_quantiles(runs, [], metric, {"p05": 0.05, "p95": 0.95}))


def attribution_ladder(rungs: DataFrame, rung: str, value: str) -> DataFrame:
    """Change of the value from each rung to the next (one row per rung)."""
    before = F.lag(value).over(Window.orderBy(rung))
    return rungs.withColumn("change", F.col(value) - before)


def model_comparison(scores: DataFrame, model: str, feature_set: str, sets: Sequence[str], value: str, published: dict[str, float]) -> DataFrame:
    """Leaderboard: one column per feature set and the difference of the last one to the published number."""
    wide = scores.groupBy(model).pivot(feature_set, list(sets)).agg(F.max(value))
    known = F.create_map(*[F.lit(x) for pair in published.items() for x in pair])
    return wide.withColumn("diff_published", F.col(f"`{sets[-1]}`") - F.try_element_at(known, F.col(model)))


# --------------------------------------------------------------------------- attributions
def _coprime(n: int, start: int) -> int:
    a = max(start % n, 1)
    while math.gcd(a, n) != 1:
        a += 1
    return a


def _numbered(df: DataFrame, key: Sequence[str], columns: Sequence[str], seed: int, extra: Sequence[str] = ()) -> tuple[DataFrame, int]:
    """Rows numbered 0..n-1 in hash order with their feature array, and n."""
    shaped = df.select(*key, *extra, F.array(*ft.ordered_features(df, columns)).alias("x"))
    order = [F.xxhash64(*key, F.lit(seed)), *[F.col(k) for k in key]]
    # long: positions are multiplied by numbers up to n
    out = freeze(with_positions(shaped, [], order, "pos").withColumn("pos", F.col("pos").cast("long") - 1))
    return out, out.count()


def _score(model, df: DataFrame, array: str) -> DataFrame:
    return model.transform(df.withColumn("features", array_to_vector(F.col(array)))).drop("features")


def permutation_importance(model, df: DataFrame, key: Sequence[str], columns: Sequence[str], target: str, repeats: int = 3, seed: int = 42) -> DataFrame:
    """Drop of R2 when one feature is shuffled: feature, mean and sd over the repeats. All shuffles are scored in one job.

    Shuffles are affine permutations of positions in a hash order, so a shuffle is one equi-join and no sort.
    """
    rows, n = _numbered(df, key, columns, seed, [target])
    rng = random.Random(seed)
    maps = [(_coprime(n, rng.randrange(1, max(n, 2))), rng.randrange(n)) for _ in range(repeats)]
    partner = F.explode(F.array(*[F.struct(F.lit(i).alias("repeat"), ((F.col("pos") * a + b) % n).alias("other")) for i, (a, b) in enumerate(maps)])).alias("m")
    paired = rows.select(target, "x", partner).select(target, "x", "m.repeat", "m.other").join(
        rows.select(F.col("pos").alias("other"), F.col("x").alias("z")), "other")
    cases = F.array(F.struct(F.lit("__base").alias("feature"), F.col("x").alias("v")), *[
        F.struct(F.lit(c).alias("feature"),
                 F.transform("x", lambda v, i: F.when(i == F.lit(j), F.get(F.col("z"), F.lit(j))).otherwise(v)).alias("v")) for j, c in enumerate(columns)])
    scored = _score(model, paired.select(target, "repeat", F.explode(cases).alias("c")).select(target, "repeat", "c.feature", "c.v"), "v")
    error = F.col(target) - F.col("prediction")
    r2 = scored.groupBy("repeat", "feature").agg((1 - F.sum(error * error) / (F.var_pop(target) * F.count(target))).alias("r2"))
    base = r2.filter("feature = '__base'").select("repeat", F.col("r2").alias("__b"))
    drop = r2.filter("feature <> '__base'").join(base, "repeat").withColumn("drop", F.col("__b") - F.col("r2"))
    return drop.groupBy("feature").agg(F.avg("drop").alias("importance"), F.stddev_samp("drop").alias("sd"))


def shapley_sample(model, df: DataFrame, key: Sequence[str], columns: Sequence[str], samples: int = 8, seed: int = 42) -> DataFrame:
    """Monte-Carlo Shapley values per row: key, feature, value, phi, prediction, base, residual.

    Every sample draws a feature order and a background row; features switch from background to own value in that
    order and the change of the prediction is credited to the feature that switched. Attributions of a row add up to
    prediction minus the mean background prediction (`base`); `residual` reports the remaining gap.
    """
    rows, n = _numbered(df, key, columns, seed)
    rng = random.Random(seed)
    maps = [(_coprime(n, rng.randrange(1, max(n, 2))), rng.randrange(n)) for _ in range(samples)]
    draw = F.explode(F.array(*[F.struct(F.lit(i).alias("sample"), ((F.col("pos") * a + b) % n).alias("other")) for i, (a, b) in enumerate(maps)])).alias("m")
    paired = rows.select(*key, "x", draw).select(*key, "x", "m.sample", "m.other").join(
        rows.select(F.col("pos").alias("other"), F.col("x").alias("z")), "other")
    order = F.array_sort(F.array(*[F.struct(F.xxhash64(*key, "sample", F.lit(seed), F.lit(j)).alias("h"), F.lit(j).alias("j")) for j in range(len(columns))]))
    placed = paired.withColumn("o", F.transform(order, lambda s: s["j"]))
    steps = F.transform(F.sequence(F.lit(0), F.lit(len(columns))), lambda s: F.struct(
        s.alias("step"), F.transform("x", lambda v, i: F.when(F.array_position("o", i) <= s, v).otherwise(F.get(F.col("z"), i))).alias("v")))
    scored = _score(model, placed.select(*key, "sample", "x", "o", F.explode(steps).alias("s")).select(*key, "sample", "x", "o", "s.step", "s.v"), "v")
    walks = scored.groupBy(*key, "sample").agg(
        F.array_sort(F.collect_list(F.struct("step", "prediction"))).alias("w"), F.first("o").alias("o"), F.first("x").alias("x"))
    names = F.array(*[F.lit(c) for c in columns])
    credit = walks.select(*key, "sample", F.col("w")[0]["prediction"].alias("start"), F.col("w")[len(columns)]["prediction"].alias("prediction"), F.explode(F.transform(
        "o", lambda j, i: F.struct(F.get(names, j).alias("feature"), F.get(F.col("x"), j).alias("value"),
                                   (F.get(F.col("w"), i + 1)["prediction"] - F.get(F.col("w"), i)["prediction"]).alias("d")))).alias("c"))
    per = credit.groupBy(*key, "c.feature").agg(
        F.max("c.value").alias("value"), F.avg("c.d").alias("phi"), F.avg("prediction").alias("prediction"), F.avg("start").alias("base"))
    return attach_stats(per, list(key), F.sum("phi").alias("__sum")).withColumn(
        "residual", F.col("prediction") - F.col("base") - F.col("__sum")).drop("__sum")


def attribution_summary(attributions: DataFrame, block_of: dict[str, str], default: str = "other") -> DataFrame:
    """Per feature: mean |phi|, rank, % share, block, Pearson direction of value against phi, and exp(mean phi) - 1 in %."""
    per = attributions.groupBy("feature").agg(
        F.avg(F.abs("phi")).alias("mean_abs_phi"), F.avg("phi").alias("mean_phi"), correlation(F.col("value"), F.col("phi")).alias("direction"))
    block = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in block_of.items() for x in pair]), F.col("feature")), F.lit(default))
    shared = attach_scalar(per, per.agg(F.sum("mean_abs_phi").alias("__t")))
    ranked = with_value_rank(shared, [], "mean_abs_phi", True, "__r")
    return ranked.select("feature", "mean_abs_phi", F.col("__r_min").cast("long").alias("rank"), (100 * F.col("mean_abs_phi") / F.col("__t")).alias("share_pct"),
                         block.alias("block"), "direction", (100 * F.expm1("mean_phi")).alias("effect_pct"))


def attribution_direction(attributions: DataFrame, feature: str) -> DataFrame:
    """Spearman correlation of a feature's value and its attribution."""
    return spearman(attributions.filter(F.col("feature") == feature), "value", "phi")


def waterfall_steps(df: DataFrame, key: Sequence[str], order: Column, phi: str, base: Column) -> DataFrame:
    """Running total from the base through the grouped attributions of each exemplar (a handful of rows per key)."""
    frame = Window.partitionBy(*key).orderBy(order)
    end = base + F.sum(phi).over(frame.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("step", F.row_number().over(frame)).withColumn("end", end).withColumn("start", F.col("end") - F.col(phi))


def residuals(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.withColumn("residual", F.col(y) - F.col(p))


def reproduction_gate(new: DataFrame, reference: DataFrame, key: str, value: str, tolerance: float, k: int = 10) -> DataFrame:
    """Largest difference, agreement of the top k keys, missing keys, and the verdict (`expect.enforce` raises on it)."""
    joined = new.select(key, F.col(value).alias("a")).join(reference.select(key, F.col(value).alias("b")), key, "full_outer")
    stats = joined.agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("max_abs_diff"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("missing"))
    top = lambda df: df.orderBy(F.col(value).desc(), F.col(key)).limit(k).select(key)
    agree = top(new).join(top(reference), key).agg(F.count("*").alias("top_k_agree"))
    out = attach_scalar(stats, agree)
    ok = F.coalesce(F.col("max_abs_diff") <= tolerance, F.lit(False)) & (F.col("missing") == 0)
    return out.select(F.lit("reproduction").alias("check"), ok.alias("ok"), "max_abs_diff", "missing", "top_k_agree")
