"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelytics.session import freeze


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): every node of `edges` and the smallest node it can reach.

    Edges with a null end, loops and repeats are ignored; a table without edges gives no rows. Each step replaces edges
    by edges to a smaller neighbour, which needs a number of steps that is logarithmic in the longest path. The
    minimum per node combines in the map tasks and the join back can be split by AQE, so a hub with a third of all
    edges stays balanced. Every step is written to the shared checkpoint folder.
    """
    e = freeze(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("x"), F.col(b).alias("y"))
        .filter("x IS NOT NULL AND y IS NOT NULL AND x != y").select("u", "v").distinct()
    )
    before = _fingerprint(e)
    while before[0]:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").unionAll(low.select("u", F.col("m").alias("v")))
        e = freeze(small.distinct())
        now = _fingerprint(e)
        if now == before:
            break
        before = now
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
