"""A bounded sample that depends neither on order nor on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def smallest_hashes(df: DataFrame, key: Column, most: int) -> DataFrame:
    """At most `most` rows of `df`: those whose key has the smallest hash; all rows of a smaller table.

    A first pass counts the rows, and only those below a hash that about three times as many as wanted reach are sorted, so
    what tasks send on stays bounded however many tasks there are. Equal keys go in or out together up to the last place.
    """
    hashed = df.withColumn("__hash", F.xxhash64(key))
    count = df.count()
    if count > 3 * most:
        hashed = hashed.filter(F.col("__hash") < int(-(2**63) + 3 * most / count * 2**64))
    return hashed.orderBy("__hash").limit(most).drop("__hash")


def smallest_keys(df: DataFrame, key: Column, most: int) -> DataFrame:
    """The rows of `df` with the at most `most` different keys of the smallest hashes, however many rows share a key."""
    keys = df.select(F.xxhash64(key).alias("__hash")).distinct()
    count = keys.count()
    if count > 3 * most:
        keys = keys.filter(F.col("__hash") < int(-(2**63) + 3 * most / count * 2**64))
    chosen = [r["__hash"] for r in keys.orderBy("__hash").limit(most).collect()]
    return df.filter(F.xxhash64(key).isin(chosen)) if chosen else df.limit(0)
