"""Ranks, limits, upserts and key-set comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelytics.plans.scale import (
    attach_scalar, keep_first, keep_last, top_k_per_group, with_positions,
)


def ends_side_by_side(df: DataFrame, order: Column, reverse: Column, columns: Sequence[str], k: int) -> DataFrame:
    """The k first and k last rows next to each other by position (k rows on each side)."""
    place = Window.orderBy("__o")

    def side(by: Column, prefix: str) -> DataFrame:
        few = df.withColumn("__s", F.struct(*columns)).orderBy(by).limit(k)
        numbered = few.withColumn("__o", F.monotonically_increasing_id()).withColumn("position", F.row_number().over(place))
        return numbered.select("position", *[F.col(f"__s.{c}").alias(f"{prefix}_{c}") for c in columns])

    return side(order, "top").join(side(reverse, "bottom"), "position", "full_outer")


def top_k_plus_other(df: DataFrame, category: str, k: int, other: str = "Other", unknown: str = "Unknown") -> DataFrame:
    """The k most frequent categories (count desc, name), the rest summed as one."""
    counts = df.groupBy(F.coalesce(F.col(category), F.lit(unknown)).alias(category)).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.col("n").desc(), F.col(category)).limit(k).select(category, F.lit(True).alias("__top"))
    marked = counts.join(F.broadcast(top), category, "left")  # at most k rows
    return marked.groupBy(F.when(F.col("__top"), F.col(category)).otherwise(F.lit(other)).alias(category)).agg(
        F.sum("n").alias("n")
    )


def two_stage_top(df: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """The k most frequent keys (count desc, key), re-sorted by their mean, with the final position."""
    stats = df.groupBy(key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    top = stats.orderBy(F.col("n").desc(), F.col(key)).limit(k)
    return top.withColumn("position", F.row_number().over(Window.orderBy(F.col("mean").desc(), F.col(key))))


def upsert_last(batches: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Append batches in order; the last batch that holds a key wins."""
    tagged = [b.withColumn("__batch", F.lit(i)) for i, b in enumerate(batches)]
    union = tagged[0]
    for more in tagged[1:]:
        union = union.unionByName(more)
    return keep_last(union, keys, [F.col("__batch")]).drop("__batch")


def keep_first_unique(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return keep_first(df, keys, order)


def set_reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Every distinct key of either side with `side`: both, left or right."""
    both = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    flags = both.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    side = F.when((F.col("l") == 1) & (F.col("r") == 1), "both").when(F.col("l") == 1, "left").otherwise("right")
    return flags.select(key, side.alias("side"))


def median_rows_at_extremes(df: DataFrame, group: str, feature: str, order: Sequence[Column]) -> DataFrame:
    """For the groups whose feature is lowest and highest: the row at place (n - 1) // 2 by `order`."""
    per_group = df.groupBy(group).agg(F.min(feature).alias("__f"), F.count("*").alias("__n"))
    ends = per_group.agg(
        F.min(F.struct("__f", group, "__n")).alias("a"), F.max(F.struct("__f", group, "__n")).alias("b")
    ).select(F.explode(F.array(F.struct(F.lit("lowest").alias("end"), F.col(f"a.{group}").alias(group), F.col("a.__n").alias("__n")),
                               F.struct(F.lit("highest").alias("end"), F.col(f"b.{group}").alias(group), F.col("b.__n").alias("__n")))).alias("e")
             ).select("e.*")
    rows = df.join(F.broadcast(ends), group)  # two rows
    placed = with_positions(rows, ["end"], order, "__rn")
    return placed.filter(F.col("__rn") == F.floor((F.col("__n") - 1) / 2) + 1).drop("__rn", "__n")


def percentile_of(df: DataFrame, value: str, column: str) -> DataFrame:
    """For every row: percent of rows whose |value| is not larger, from counts of distinct magnitudes."""
    magnitude = df.withColumn("__m", F.abs(value))
    counts = magnitude.groupBy("__m").agg(F.count("*").alias("__k"))
    running = with_positions(counts, [], [F.col("__m").asc()], "__p", {"__cum": F.col("__k")})
    share = attach_scalar(running, counts.agg(F.sum("__k").alias("__t"))).select(
        "__m", (100 * F.col("__cum") / F.col("__t")).alias(column)
    )
    return magnitude.join(share, "__m", "left").drop("__m")


def latest_n(df: DataFrame, user: str, time: str, tie: str, n: int) -> DataFrame:
    """The newest n rows per user."""
    return top_k_per_group(df, [user], [F.col(time).desc(), F.col(tie).desc()], n, "recency")


