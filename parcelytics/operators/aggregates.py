"""Group profiles, contrasts and evidence tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelytics.functions import blocks, numeric, text
from parcelytics.plans.scale import (
    attach_scalar, attach_stats, exact_quantiles, is_small, maybe_broadcast, null_safe_join, quantile_of_columns, stack_rows, top_k_per_group,
    with_positions, with_value_rank,
)
from parcelytics.session import freeze


def group_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """n, sum, min, q1, median, q3, iqr and max of a value per group; n counts all rows of the group."""
    basic = [F.count("*").alias("n"), F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max")]
    out = exact_quantiles(df, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, also=basic)
    return out.withColumn("iqr", F.col("q3") - F.col("q1"))


def frequency_rank(counts: DataFrame, key: str, n: str, name: str = "frequency_rank") -> DataFrame:
    """1-based rank by (-count, key) over a table that already has one row per key (G2)."""
    return with_positions(counts, [], [F.col(n).desc(), F.col(key).asc()], name)


def weighted_centroid(df: DataFrame, keys: Sequence[str], weight: str, columns: Sequence[str]) -> DataFrame:
    """Weighted means; NULL weight counts as 0 and a group of total weight 0 falls back to the plain mean."""
    w = F.coalesce(F.col(weight), F.lit(0.0))
    total = F.nullif(F.sum(w), F.lit(0.0))
    return df.groupBy(*keys).agg(
        *[F.coalesce(F.sum(F.col(c) * w) / total, F.avg(c)).alias(c) for c in columns]
    )


def merge_units(
    df: DataFrame, keys: Sequence[str], order: Column, listed: dict[str, str], sets: dict[str, str], sums: dict[str, str],
) -> DataFrame:
    """Merge units sharing a key: member count, ordered joined lists, sorted distinct joined sets, and sums."""
    ordered = lambda c: F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col(c).cast("string").alias("v")))), lambda s: s["v"]),
        " | ",
    )
    return df.groupBy(*keys).agg(
        F.count("*").alias("n_members"),
        *[ordered(c).alias(name) for name, c in listed.items()],
        *[F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), " | ").alias(name) for name, c in sets.items()],
        *[F.sum(c).alias(name) for name, c in sums.items()],
    )


def totals_row(df: DataFrame, key: str, aggregates: Sequence[Column], label: str = "TOTAL") -> DataFrame:
    """Grouped aggregates plus one total row, from a single rollup."""
    rolled = df.rollup(key).agg(F.grouping(key).alias("__g"), *aggregates)
    return rolled.withColumn(
        key, F.when(F.col("__g") == 1, F.lit(label)).otherwise(F.col(key).cast("string"))
    ).drop("__g")


def sample_members(df: DataFrame, keys: Sequence[str], member: str, limit: int = 3) -> DataFrame:
    """Group size, smallest member, number of distinct members, and the first few distinct members joined.

    Members are de-duplicated and cut to the first few per group before they are listed, so no group's full
    member set is ever collected.
    """
    sizes = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min(member).alias("first_member"), F.count_distinct(member).alias("n_members")
    )
    distinct = df.filter(F.col(member).isNotNull()).select(*keys, member).distinct()
    few = top_k_per_group(distinct, keys, [F.col(member)], limit).groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", F.col(member).cast("string").alias("v")))),
                                 lambda s: s["v"]), ", ").alias("sample")
    )
    return null_safe_join(sizes, few, keys, "left")


def dependency_violations(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that map to more than one value, with every (key, value, rows) behind them."""
    pairs = df.groupBy(key, value).agg(F.count("*").alias("n"))
    marked = attach_stats(pairs, [key], F.count("*").alias("n_values"))
    return marked.filter("n_values > 1")


def dup_groups(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Histogram of group sizes: size, groups, rows, and rows a dedup would remove."""
    sizes = df.groupBy(*key).agg(F.count("*").alias("group_size"))
    return sizes.groupBy("group_size").agg(
        F.count("*").alias("groups"), F.sum("group_size").alias("rows"), F.sum(F.col("group_size") - 1).alias("removed")
    )


def dup_evidence(
    df: DataFrame, key: Sequence[str], order: Column, body: str, date: str, distinct: dict[str, str],
    similarity=text.edit_ratio,
) -> DataFrame:
    """Per group of re-posts: size, distinct counts, date span, and min/mean similarity of each member to the first.

    `similarity(member, first)` is a column expression: `text.edit_ratio`, or `member_blocks` for the ratio of matching blocks.
    """
    first = df.groupBy(*key).agg(
        F.count("*").alias("n"), F.min(F.struct(order.alias("o"), F.col(body).alias("b"))).alias("__f"),
        F.datediff(F.max(date), F.min(date)).alias("span_days"),
        *[F.count_distinct(c).alias(name) for name, c in distinct.items()],
    ).filter("n > 1")
    members = df.withColumn("__o", order)
    joined = null_safe_join(members, first.select(*key, "__f"), key, "inner")
    others = joined.filter(F.col("__o") != F.col("__f.o")).withColumn("__s", similarity(F.col(body), F.col("__f.b")))
    scored = others.groupBy(*key).agg(F.min("__s").alias("min_similarity"), F.avg("__s").alias("mean_similarity"))
    return null_safe_join(first.drop("__f"), scored, key, "left")


def member_blocks(member: Column, first: Column) -> Column:
    """Matching ratio of the first text and another member's, in that order."""
    return blocks.matching_ratio(first, member)


def threshold_counts(df: DataFrame, score: str, thresholds: Sequence[float]) -> DataFrame:
    """Rows reaching each threshold (cumulative), in one pass."""
    counts = df.agg(*[F.count_if(F.col(score) >= float(x)).alias(f"t{i}") for i, x in enumerate(thresholds)])
    return stack_rows(counts, [(F.lit(float(x)), F.col(f"t{i}")) for i, x in enumerate(thresholds)], ["threshold", "n"])


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Count and share of each value; the total comes from the counts, not from a second scan."""
    counts = df.groupBy(col).agg(F.count("*").alias("n"))
    return attach_scalar(counts, counts.agg(F.sum("n").alias("__t"))).withColumn(
        "share_pct", 100 * F.col("n") / F.col("__t")
    ).drop("__t")


def missing_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per numeric column: missing count and percent, min, median, mean, max; one pass plus the exact medians."""
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(columns):
        aggs += [F.count(c).alias(f"n{i}"), F.min(c).cast("double").alias(f"lo{i}"), F.max(c).cast("double").alias(f"hi{i}"),
                 F.avg(c).alias(f"av{i}")]
    medians = quantile_of_columns(df, [], columns, 0.5)
    stats = attach_scalar(df.agg(*aggs), medians.select(*[F.col(c).alias(f"md{i}") for i, c in enumerate(columns)]))
    missing = lambda i: F.col("rows") - F.col(f"n{i}")
    rows = [
        (F.lit(c), missing(i), 100 * missing(i) / F.col("rows"), F.col(f"lo{i}"), F.col(f"md{i}"), F.col(f"av{i}"), F.col(f"hi{i}"))
        for i, c in enumerate(columns)
    ]
    return stack_rows(stats, rows, ["column", "missing", "missing_pct", "min", "median", "mean", "max"])


def full_row_duplicates(df: DataFrame) -> DataFrame:
    """Rows beyond the first of identical rows: number of repeated rows and of extra rows."""
    sizes = df.groupBy(*df.columns).agg(F.count("*").alias("__n"))
    return sizes.agg(
        F.count_if(F.col("__n") > 1).alias("repeated_rows"), F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("extra_rows")
    )


def event_fold_by_key(df: DataFrame, key: str, keys: DataFrame, date: str, sums: Sequence[str]) -> DataFrame:
    """Count, distinct years, first, last and sums per key, for the complete key list with zeros."""
    folded = df.groupBy(key).agg(
        F.count("*").alias("records"), F.count_distinct(F.year(date)).alias("years"),
        F.min(date).alias("first"), F.max(date).alias("last"), *[F.sum(c).alias(c) for c in sums],
    )
    return keys.select(key).join(folded, key, "left").na.fill(0, ["records", "years", *sums])


def year_list_per_key(df: DataFrame, key: str, date: str) -> DataFrame:
    """Sorted distinct years per key (a set bounded by the calendar)."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set(F.year(date))).alias("years"))


def multi_membership_sum(df: DataFrame, key: str, delimited: str, dim: DataFrame, member: str, value: str, sep: str = "; ") -> DataFrame:
    """Explode a delimited member list, add up a dimension value, 0 where nothing matches."""
    members = df.select(key, F.explode(F.split(delimited, sep)).alias(member))
    joined = members.join(maybe_broadcast(dim.select(member, value)), member, "left")
    return joined.groupBy(key).agg(F.sum(F.coalesce(F.col(value), F.lit(0))).alias(value))


def division_lookup(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Serving table: exact median of every feature per division, and the listing count."""
    return quantile_of_columns(df, [key], columns, 0.5, also=[F.count("*").alias("listing_count")])


def global_row(lookup: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Column medians of the lookup: the fallback row. A large lookup is settled first, because the medians read it several times."""
    if not is_small(lookup):
        lookup = freeze(lookup)
    return quantile_of_columns(lookup, [], columns, 0.5)


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width bins over [min, max], last bin closed, empty bins included."""
    edges = df.agg(F.min(value).cast("double").alias("__lo"), F.max(value).cast("double").alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / bins
    index = F.least(F.floor((F.col(value) - F.col("__lo")) / width), F.lit(bins - 1))
    counts = (
        attach_scalar(df.filter(F.col(value).isNotNull()).select(value), edges)
        .groupBy(F.when(width == 0, F.lit(0)).otherwise(index).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    )
    grid = edges.select("__lo", "__hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(counts, "bin", "left").select(
        F.col("bin").cast("long").alias("bin"), (F.col("__lo") + F.col("bin") * width).alias("left_edge"),
        (F.col("__lo") + (F.col("bin") + 1) * width).alias("right_edge"), F.coalesce("n", F.lit(0)).alias("n"),
    )


def moments(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """n, mean, sample sd, bias-adjusted skewness, min, max."""
    n = F.count(value)
    adjust = F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0))
    return df.groupBy(*keys).agg(
        n.alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
        (F.skewness(value) * adjust).alias("skew"), F.min(value).alias("min"), F.max(value).alias("max"),
    )


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation over complete pairs; NULL instead of a division error when a side is constant."""
    x, y = F.when(b.isNotNull(), a.cast("double")), F.when(a.isNotNull(), b.cast("double"))
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every column pair, long form; a pair skips rows where either is NULL. One pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    stats = df.agg(*[correlation(F.col(a), F.col(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return stack_rows(stats, [(F.lit(a), F.lit(b), F.col(f"r{i}")) for i, (a, b) in enumerate(pairs)], ["a", "b", "r"])


def group_basis(df: DataFrame, key: str, columns: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per group: the first non-NULL value of each column by `order`."""
    position = [o.alias(f"o{i}") for i, o in enumerate(order)]
    return df.groupBy(key).agg(
        *[F.min(F.when(F.col(c).isNotNull(), F.struct(*position, F.col(c).alias("v"))))["v"].alias(c) for c in columns]
    )


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks for ties; one row: n, rho."""
    both = df.select(x, y).filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = with_value_rank(with_value_rank(both, [], x, prefix="__rx"), [], y, prefix="__ry")
    return ranked.agg(F.count("*").alias("n"), correlation(F.col("__rx_avg"), F.col("__ry_avg")).alias("rho"))


def mann_whitney(df: DataFrame, value: str, in_first: Column) -> DataFrame:
    """Two-sample rank test: sizes, medians, U of the first sample, tie-corrected z, two-sided normal p."""
    data = df.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"), in_first.alias("g")).filter("g IS NOT NULL")
    ranked = with_value_rank(data, [], "v", prefix="__r")
    sums = ranked.agg(
        F.count_if("g").alias("n1"), F.count_if(~F.col("g")).alias("n2"), F.sum(F.when(F.col("g"), F.col("__r_avg"))).alias("r1")
    )
    ties = data.groupBy("v").agg(F.count("*").alias("k")).agg(F.sum(F.col("k") * F.col("k") * F.col("k") - F.col("k")).cast("double").alias("ties"))
    medians = attach_scalar(
        exact_quantiles(data.filter("g"), [], "v", {"median1": 0.5}), exact_quantiles(data.filter("NOT g"), [], "v", {"median2": 0.5})
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = (u - n1 * n2 / 2) / sd
    return attach_scalar(attach_scalar(sums, ties), medians).select(
        "n1", "n2", "median1", "median2", u.alias("u"), z.alias("z"), (2 * (1 - numeric.normal_cdf(F.abs(z)))).alias("p")
    )


def pivot_compare(df: DataFrame, index: str, column: str, values: Sequence[str], metric: str, base: str) -> DataFrame:
    """Wide table (one column per declared value) and the difference of each to the base."""
    wide = df.groupBy(index).pivot(column, list(values)).agg(F.first(metric, ignorenulls=True))
    return wide.select(index, *values, *[(F.col(v) - F.col(base)).alias(f"delta_{v}") for v in values if v != base])


def block_share(df: DataFrame, feature: str, value: str, blocks: dict[str, str], default: str) -> DataFrame:
    """Sum and percent share per block of features."""
    block = F.lit(default)
    for name, label in blocks.items():
        block = F.when(F.col(feature) == name, F.lit(label)).otherwise(block)
    sums = df.groupBy(block.alias("block")).agg(F.sum(value).alias("total"), F.count("*").alias("n_features"))
    return attach_scalar(sums, sums.agg(F.sum("total").alias("__t"))).withColumn(
        "share_pct", 100 * F.col("total") / F.col("__t")
    ).drop("__t")


def registry_dedup(df: DataFrame, code: str, name: str, address: Column) -> DataFrame:
    """One entity per normalised address (blank never merges): kept code and name, merged codes, how many."""
    key = F.coalesce(F.nullif(address, F.lit("")), F.concat(F.lit("__nokey__"), F.col(code).cast("string")))
    return df.groupBy(key.alias("key")).agg(
        F.min(F.struct(code, name)).alias("__k"), F.count("*").alias("n_merged"),
        F.array_join(F.transform(F.array_sort(F.collect_set(code)), lambda c: c.cast("string")), " ").alias("codes"),
    ).select("key", F.col(f"__k.{code}").alias(code), F.col(f"__k.{name}").alias(name), "n_merged", "codes")


def keyed_counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))
