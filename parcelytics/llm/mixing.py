"""Mixing sources to target weights: whole repetitions plus one hash-seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelytics.plans.scale import null_safe_join, with_positions
from parcelytics.session import freeze

#: Weights of the sources in name order, most repetitions of a source, and the seed of the Bernoulli copies.
WEIGHTS, MOST_REPEATS, SEED = (1, 2, 3), 3.0, "mix-1"


def n_words(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def unit_hash(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from 52 bits of the md5 of seed and key, the same in every engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / float(2**52)


def targets(sizes: DataFrame, source: str = "source", size: str = "size", weights: tuple = WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target, rate) of a table of rows with a source and a size.

    Sources in order of their code points, null last, weigh `weights` in turn; their targets share the sum of all sizes
    by weight. A target stops at `most` times its source's size and the excess is shared by weight among the others,
    again until none is above. Sources of size 0 have target and rate 0. The table has one row per source and stays
    distributed; a round of the sharing takes two sums to the driver.
    """
    per = sizes.groupBy(source).agg(F.sum(size).cast("long").alias("source_size"))
    per = per.select(F.col(source).alias("source"), "source_size")
    placed = with_positions(per, [], [F.col("source").asc_nulls_last()], "__rank", one_task_bytes=-1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("__rank") - 1) % len(weights) + 1).cast("int"))
    table = freeze(placed.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("cap")))
    first = table.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first()
    total, open_weight = float(first["s"] or 0), first["w"] or 0.0
    # a source is at its cap when its weight times the level reaches it; the level only rises
    level = total / open_weight if open_weight else 0.0
    while total:
        row = table.agg(
            F.sum(F.when(F.col("weight") * level >= F.col("cap"), F.col("cap"))).alias("capped"), F.sum(F.when(F.col("weight") * level < F.col("cap"), F.col("weight"))).alias("w")
        ).first()
        if not row["w"]:
            break
        higher = (total - (row["capped"] or 0.0)) / row["w"]
        if higher <= level:
            break
        level = higher
    target = F.least(F.col("weight") * level, F.col("cap"))
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0))
    return table.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def with_copies(
    df: DataFrame, source: str = "source", size: Column | None = None, key: str = "doc_id", weights: tuple = WEIGHTS, most: float = MOST_REPEATS, seed: str = SEED
) -> DataFrame:
    """`df` with size, source_size, target, rate and copies: how often the mix takes the row.

    copies = floor(rate), plus one when the hash of seed and key falls below the fraction of the rate. Reruns agree,
    equal keys decide alike, a null key counts as the empty one, and no row is taken more often than the cap allows.
    Null texts have size 0; a null source is a source of its own. An empty table gives no rows.
    """
    size = n_words(F.col("text")) if size is None else size
    sized = df.drop("size", "source_size", "target", "rate", "copies").withColumn("size", size)
    rates = targets(sized.select(source, "size"), source, "size", weights, most).withColumnRenamed("source", source)
    joined = null_safe_join(sized, rates, [source])
    extra = (unit_hash(F.col(key), seed) < F.col("rate") - F.floor("rate")).cast("long")
    return joined.withColumn("copies", F.floor("rate").cast("long") + extra)


def mix(df: DataFrame, source: str = "source", size: Column | None = None, key: str = "doc_id", **settings) -> DataFrame:
    """The rows of the mix: each row of `df` as often as `with_copies` says, with the columns of `df`."""
    counted = with_copies(df, source, size, key, **settings)
    return counted.filter("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*df.columns)
