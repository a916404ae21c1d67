"""Registered queries: each runs a library operator over the driver tables, with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(col: Column | str, digits: int = 6) -> Column:
    """Round by scaling, the way the SQL side does, so that ties fall the same way; keeps a column's name."""
    expression = F.col(col) if isinstance(col, str) else col
    scale = float(10**digits)
    out = F.round(expression * scale, 0) / scale
    return out.alias(col) if isinstance(col, str) else out


class Tables:
    """The driver tables by attribute, and the domain views derived from them by plain arithmetic."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        from parcelytics.catalog import views

        builder = getattr(views, f"view_{name}", None)
        if builder is not None:
            return builder(self)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register `fn(tables)` under `name`; `sql` is the equivalent query for the reference database."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            from parcelytics.catalog import views

            ORACLES[name] = views.expand_sql(sql)
        return fn

    return wrap

