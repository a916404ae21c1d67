"""Data-quality expectations: each returns a small table (check, ok, detail); `enforce` raises on a failure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelytics.functions import geo
from parcelytics.operators import aggregates


class ExpectationFailed(ValueError):
    pass


def enforce(checks: DataFrame) -> DataFrame:
    """Raise with the details when any check failed (a checks table has a handful of rows)."""
    failed = checks.filter("NOT ok").limit(20).collect()
    if failed:
        raise ExpectationFailed("; ".join(f"{r['check']}: {r['detail']}" for r in failed))
    return checks


def _check(stats: DataFrame, name: str, ok: Column, detail: Column) -> DataFrame:
    return stats.select(F.lit(name).alias("check"), F.coalesce(ok, F.lit(False)).alias("ok"), detail.cast("string").alias("detail"))


def expect_shape(df: DataFrame, rows: int | None = None, columns: int | None = None, group: str | None = None, groups: int | None = None) -> DataFrame:
    stats = df.agg(F.count("*").alias("n"), (F.count_distinct(group) if group else F.lit(0)).alias("g"))
    ok = F.lit(columns is None or len(df.columns) == columns)
    if rows is not None:
        ok = ok & (F.col("n") == rows)
    if groups is not None:
        ok = ok & (F.col("g") == groups)
    return _check(stats, "shape", ok, F.concat_ws(" ", F.lit("rows"), F.col("n"), F.lit("columns"), F.lit(len(df.columns)), F.lit("groups"), F.col("g")))


def expect_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    repeated = df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    stats = repeated.agg(F.count("*").alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
    return _check(stats, "unique " + ",".join(keys), F.col("keys") == 0, F.concat_ws(" ", F.col("keys"), F.lit("keys over"), F.col("rows"), F.lit("rows")))


def expect_in_box(df: DataFrame, lat: str, lon: str, box: dict) -> DataFrame:
    bad = F.count_if(~F.coalesce(geo.in_box(F.col(lat), F.col(lon), box), F.lit(False)))
    return _check(df.agg(bad.alias("bad")), "coordinates in box", F.col("bad") == 0, F.concat_ws(" ", F.col("bad"), F.lit("rows outside or missing")))


def expect_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    stats = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    total = sum((F.col(c) for c in columns), F.lit(0))
    return _check(stats, "not null " + ",".join(columns), total == 0, F.concat_ws(" ", total, F.lit("missing values")))


def expect_one_value_per_key(df: DataFrame, key: str, value: str) -> DataFrame:
    stats = aggregates.dependency_violations(df, key, value).agg(F.count_distinct(key).alias("bad"))
    return _check(stats, f"one {value} per {key}", F.col("bad") == 0, F.concat_ws(" ", F.col("bad"), F.lit("keys with several values")))


def expect_points_inside(df: DataFrame, lat: str, lon: str, box: dict, margin: float = 0.15) -> DataFrame:
    """The box must hold all points with the margin on every side."""
    stats = df.agg(F.min(lat).alias("a"), F.max(lat).alias("b"), F.min(lon).alias("c"), F.max(lon).alias("d"))
    slack = F.least(F.col("a") - box["lat"][0], box["lat"][1] - F.col("b"), F.col("c") - box["lon"][0], box["lon"][1] - F.col("d"))
    return _check(stats, "points inside box with margin", slack >= margin, F.round(slack, 4))


def expect_close(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str], tolerance: float) -> DataFrame:
    """Largest absolute difference over the shared keys stays within the tolerance."""
    other = right.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    differences = [F.abs(F.col(c) - F.col(f"__{c}")) for c in columns]
    gap = F.greatest(*differences) if len(columns) > 1 else differences[0]
    stats = left.join(other, key).agg(F.max(gap).alias("gap"))
    return _check(stats, "close " + ",".join(columns), F.col("gap") <= tolerance, F.round("gap", 6))


def expect_area(units: DataFrame, key: str, rings: str, expected: str, tolerance: float = 0.01) -> DataFrame:
    """Spherical area of the rings against a stated area (same unit), relative error per unit at most `tolerance`."""
    area = F.aggregate(F.transform(F.col(rings), lambda ring: geo.spherical_ring_area(ring)), F.lit(0.0), lambda a, x: a + x)
    error = F.abs(area - F.col(expected)) / F.col(expected)
    stats = units.select(error.alias("e")).agg(F.max("e").alias("worst"), F.count_if(F.col("e") > tolerance).alias("bad"))
    return _check(stats, f"area of {key}", F.col("bad") == 0, F.concat_ws(" ", F.col("bad"), F.lit("units off, worst"), F.round("worst", 6)))


def expect_dim_values(names: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Every mapping target exists in the dimension."""
    missing = names.join(dim.select(key).distinct(), key, "left_anti").agg(F.count_distinct(key).alias("missing"))
    return _check(missing, f"{key} exists", F.col("missing") == 0, F.concat_ws(" ", F.col("missing"), F.lit("unknown names")))


def coverage_report(df: DataFrame, split: str, ok: Column) -> DataFrame:
    """Units kept, failed and percent kept per split value, with a total row."""
    totals = [F.count_if(ok).alias("kept"), F.count_if(~ok).alias("failed")]
    return aggregates.totals_row(df, split, totals).withColumn("kept_pct", 100 * F.col("kept") / (F.col("kept") + F.col("failed")))
