"""Rule-based cleaning that keeps every dropped row with its reason."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelytics import fixed_values as fv
from parcelytics.functions import geo, numeric, text
from parcelytics.plans.scale import (
    attach_scalar, attach_stats, exact_quantiles, maybe_broadcast, null_safe_join, stack_rows,
)
from parcelytics.session import freeze

Rule = tuple[str, Column] | tuple[str, Column, Column]


def apply_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add drop_rule and drop_note: the first rule whose condition is true; NULL for kept rows.

    A rule is (label, condition) or (label, condition, note). Rules that need statistics of the survivors go in
    a later call.
    """
    rule, note = F.lit(None).cast("string"), F.lit(None).cast("string")
    for item in reversed(list(rules)):
        hit = F.coalesce(item[1], F.lit(False))
        rule = F.when(hit, F.lit(item[0])).otherwise(rule)
        note = F.when(hit, item[2] if len(item) > 2 else F.lit("")).otherwise(note)
    return df.withColumn("drop_rule", rule).withColumn("drop_note", note)


def kept(flagged: DataFrame) -> DataFrame:
    return flagged.filter(F.col("drop_rule").isNull()).drop("drop_rule", "drop_note")


def dropped(flagged: DataFrame) -> DataFrame:
    return flagged.filter(F.col("drop_rule").isNotNull())


def rule_counts(flagged: DataFrame, rule_order: Sequence[str]) -> DataFrame:
    """Waterfall per rule, also for rules that hit nothing: dropped rows and rows remaining after the rule."""
    totals = flagged.agg(
        F.count("*").alias("rows_in"),
        *[F.count_if(F.col("drop_rule") == label).alias(f"n{i}") for i, label in enumerate(rule_order)],
    )
    rows, running = [], F.col("rows_in")
    for i, label in enumerate(rule_order):
        after = running - F.col(f"n{i}")
        rows.append((F.lit(i + 1).cast("long"), F.lit(label), running, F.col(f"n{i}"), after))
        running = after
    return stack_rows(totals, rows, ["step", "drop_rule", "rows_before", "dropped", "remaining"])


def classify_multi(df: DataFrame, causes: Sequence[tuple[str, Column]], default: str = "no rule matched") -> DataFrame:
    """Add `causes`: every rule that holds, in order; the default when none does."""
    found = F.array_compact(F.array(*[F.when(c, F.lit(label)) for label, c in causes]))
    return df.withColumn("causes", F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default))))


def cause_counts(classified: DataFrame) -> DataFrame:
    return classified.select(F.explode("causes").alias("cause")).groupBy("cause").agg(F.count("*").alias("n"))


def cause_combinations(classified: DataFrame) -> DataFrame:
    return classified.groupBy(F.array_join("causes", " + ").alias("combination")).agg(F.count("*").alias("n"))


def reference_median(df: DataFrame, group: str, value: str, where: Column, name: str = "ref_median") -> DataFrame:
    """Per group, the exact median of a filtered subset (E2)."""
    return exact_quantiles(df.filter(where).select(group, value), [group], value, {name: 0.5})


def scale_mislabel_filter(
    df: DataFrame, group: str, scale: str, total: str, size: str, unit: str,
    limit: float = fv.RATIO_LIMIT, swap: tuple[float, float] = fv.SCALE_SWAP,
) -> DataFrame:
    """Flag 'total' rows whose raw price reads like a per-perch price of their own group.

    The statistic comes from the rows handed in, so call it on the survivors of the earlier rules.
    """
    medians = reference_median(df, group, unit, F.col(scale) == "per perch")
    joined = null_safe_join(df, medians, [group], "left")
    implied = numeric.implied_unit_price(F.col(total), F.col(size))
    ref = F.col("ref_median")
    hit = (
        (F.col(scale) == "total") & (ref > 0) & (implied / ref < 1 / limit)
        & (F.col(total) / ref).between(*swap)
    )
    return joined.withColumn("mislabelled", F.coalesce(hit, F.lit(False)))


def ratio_outliers(df: DataFrame, group: str, value: str, reference: Column, limit: float = fv.RATIO_LIMIT) -> DataFrame:
    """Add ratio and verdict: 'no reference', 'outlier' (off by more than `limit` times either way) or 'ok'."""
    medians = reference_median(df, group, value, reference)
    joined = null_safe_join(df, medians, [group], "left")
    ratio = F.col(value) / F.col("ref_median")
    verdict = (
        F.when(F.col("ref_median").isNull() | (F.col("ref_median") <= 0), "no reference")
        .when((ratio > limit) | (ratio < 1 / limit), "outlier")
        .otherwise("ok")
    )
    return joined.withColumn("ratio", ratio).withColumn("verdict", verdict)


def clean_points(
    df: DataFrame, name: str, lat: str, lon: str, order: Sequence[Column], box: dict = fv.CLEAN_BOX,
) -> DataFrame:
    """Add `reason`: bad_coord, out_of_box, dup_name, dup_coord or NULL (kept); the earliest row wins.

    Duplicate coordinates are judged only among the survivors of the name rule. `order` must identify a row.
    """
    flagged = (
        df.withColumn("__lat", F.expr(f"try_cast(`{lat}` AS DOUBLE)")).withColumn("__lon", F.expr(f"try_cast(`{lon}` AS DOUBLE)"))
        .withColumn("__o", F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
        .withColumn("__nk", text.norm_key(F.col(name)))
        .withColumn("__clat", F.bround("__lat", 5)).withColumn("__clon", F.bround("__lon", 5))
    )
    flagged = flagged.withColumn(
        "reason",
        F.when(F.col("__lat").isNull() | F.col("__lon").isNull(), "bad_coord")
        .when(~geo.in_box(F.col("__lat"), F.col("__lon"), box), "out_of_box"),
    )
    first_name = attach_stats(flagged, ["__nk"], F.min(F.when(F.col("reason").isNull(), F.col("__o"))).alias("__f1"))
    named = first_name.withColumn(
        "reason", F.when(F.col("reason").isNull() & (F.col("__o") != F.col("__f1")), "dup_name").otherwise(F.col("reason"))
    )
    first_coord = attach_stats(
        named, ["__clat", "__clon"], F.min(F.when(F.col("reason").isNull(), F.col("__o"))).alias("__f2")
    )
    return first_coord.withColumn(
        "reason", F.when(F.col("reason").isNull() & (F.col("__o") != F.col("__f2")), "dup_coord").otherwise(F.col("reason"))
    ).drop("__lat", "__lon", "__o", "__nk", "__clat", "__clon", "__f1", "__f2")


def quantile_band(df: DataFrame, value: str, low: float = fv.PRICE_BAND[0], high: float = fv.PRICE_BAND[1]) -> DataFrame:
    """Rows inside the global percentile band, both ends included."""
    bounds = freeze(exact_quantiles(df, [], value, {"__lo": low, "__hi": high}))
    return attach_scalar(df, bounds).filter(F.col(value).between(F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")


def trim_per_group(df: DataFrame, value: str, group: str, k: float = fv.TRIM_K) -> DataFrame:
    """Keep |x - mean| <= k * sd of the group; single-row groups (sd NULL) stay."""
    stats = attach_stats(df, [group], F.avg(value).alias("__mean"), F.stddev_samp(value).alias("__sd"), settle=True)
    keep = F.coalesce(F.abs(F.col(value) - F.col("__mean")) <= k * F.col("__sd"), F.col("__sd").isNull())
    return stats.filter(keep).drop("__mean", "__sd")


def trim_sweep(df: DataFrame, value: str, group: str, ks: Sequence[float]) -> DataFrame:
    """Rows kept for each k, in one pass over the data."""
    stats = attach_stats(df, [group], F.avg(value).alias("__mean"), F.stddev_samp(value).alias("__sd"))
    off = F.abs(F.col(value) - F.col("__mean"))
    counts = stats.agg(
        F.count("*").alias("n"),
        *[F.count_if(F.coalesce(off <= float(k) * F.col("__sd"), F.col("__sd").isNull())).alias(f"k{i}")
          for i, k in enumerate(ks)],
    )
    return stack_rows(
        counts, [(F.lit(float(k)), F.col(f"k{i}"), F.col("n") - F.col(f"k{i}")) for i, k in enumerate(ks)],
        ["k", "rows_kept", "rows_dropped"],
    )


def split_by_lookup(df: DataFrame, dim: DataFrame, key: str, attribute: str, default: str) -> DataFrame:
    """Route each row to a bucket named by a dimension attribute; unknown keys go to the default bucket."""
    joined = df.join(maybe_broadcast(dim.select(key, attribute)), key, "left")
    return joined.withColumn("bucket", F.coalesce(F.col(attribute), F.lit(default))).drop(attribute)


def column_redundancy(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: all-NULL, constant, or equal to an earlier column, found in one pass."""
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.count(c).alias(f"n{i}"), F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")]
        aggs += [
            F.bool_and(F.col(c).eqNullSafe(F.col(e))).alias(f"eq{j}_{i}") for j, e in enumerate(columns[:i])
        ]
    stats = df.agg(*aggs)
    rows = []
    for i, c in enumerate(columns):
        same = F.lit(None).cast("string")
        for j in reversed(range(i)):
            same = F.when(F.col(f"eq{j}_{i}"), F.lit(columns[j])).otherwise(same)
        verdict = (
            F.when(F.col(f"n{i}") == 0, "all null").when(F.col(f"lo{i}") == F.col(f"hi{i}"), "constant")
            .when(same.isNotNull(), "identical").otherwise("keep")
        )
        rows.append((F.lit(c), verdict, same))
    return stack_rows(stats, rows, ["column", "verdict", "same_as"])


def frequent_spellings(df: DataFrame, col: str, junk_pattern: str) -> DataFrame:
    """Drop code-only strings, then one row per case-insensitive value with its most frequent spelling."""
    clean = df.filter(F.col(col).isNotNull() & ~F.col(col).rlike(junk_pattern))
    counts = clean.groupBy(F.col(col).alias("spelling")).agg(F.count("*").alias("n"))
    best = counts.groupBy(F.lower("spelling").alias("key")).agg(
        F.min(F.struct((-F.col("n")).alias("neg"), F.col("spelling"))).alias("b"), F.sum("n").alias("n")
    )
    return best.select("key", F.col("b.spelling").alias("spelling"), "n")


def dedup_keep_earliest(df: DataFrame, key: Sequence[str], date: str, order: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): per key (NULL equals NULL) the earliest date wins, missing dates last, then `order`.

    Identical rows are counted first, so copies of one row never pile up in one task; a removed row carries the
    number of copies removed in `copies`.
    """
    columns = df.columns
    # both outputs and the minimum per key read it
    unique = freeze(df.groupBy(*columns).agg(F.count("*").alias("copies")))
    position = F.struct(F.col(date).isNull().alias("missing"), F.col(date).alias("at"),
                        *[o.alias(f"o{i}") for i, o in enumerate(order)],
                        F.xxhash64(*columns).alias("h1"), F.hash(*columns).alias("h2"))
    ranked = attach_stats(unique.withColumn("__o", position), key, F.min("__o").alias("__first"))
    is_first = F.col("__o").eqNullSafe(F.col("__first"))
    keep = ranked.filter(is_first).select(*columns)
    removed = (
        ranked.withColumn("copies", F.col("copies") - is_first.cast("long")).filter("copies > 0")
        .select(*columns, "copies")
    )
    return keep, removed


