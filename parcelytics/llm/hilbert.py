"""Shards along a Hilbert curve over several metadata dimensions, by DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelytics.plans.scale import with_positions

#: Bits a dimension is quantised to, and shards.
BITS, SHARDS = 6, 16


def curve_table(dims: int) -> list[int]:
    """The curve as an automaton: entry (state * 2^dims + cell) holds (next state * 2^dims + place of the cell).

    A state is an entry corner and a direction; a cell has one bit of each dimension. The rule is the usual one: turn
    the cell into the state's frame, its inverse Gray code is its place, and the place's own corner and direction, seen
    from the frame, are the next state.
    """
    full = (1 << dims) - 1

    def turned(x: int, k: int) -> int:
        k %= dims
        return ((x << k) | (x >> (dims - k))) & full

    def ungray(x: int) -> int:
        out = 0
        while x:
            out, x = out ^ x, x >> 1
        return out

    def trailing_ones(x: int) -> int:
        return ((x + 1) & ~x).bit_length() - 1

    table = []
    for corner in range(1 << dims):
        for direction in range(dims):
            for cell in range(1 << dims):
                place = ungray(turned(cell ^ corner, -(direction + 1)))
                start = max(0, 2 * ((place - 1) // 2))
                own = trailing_ones(place - 1 if place % 2 == 0 else place) % dims if place else 0
                state = (corner ^ turned(start ^ (start >> 1), direction + 1)) * dims + (direction + own + 1) % dims
                table.append((state << dims) | place)
    return table


def hilbert_index(cells: list[Column], bits: int = BITS) -> Column:
    """Place on the curve of integer coordinates below 2^bits; all coordinates must be set."""
    dims = len(cells)
    if dims < 2 or dims * bits > 62:
        raise ValueError("two dimensions or more, and 62 bits in all at most")
    table = F.array(*[F.lit(x) for x in curve_table(dims)])
    point = F.array(*[c.cast("long") for c in cells])
    packed = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("s"), point.alias("p"))

    def step(at: Column, bit: Column) -> Column:
        cell = F.lit(0).cast("long")
        for k in range(dims):
            cell = cell + F.call_function("shiftright", F.element_at(at["p"], k + 1), bit).bitwiseAND(F.lit(1)) * (1 << k)
        move = F.element_at(table, (at["s"] * (1 << dims) + cell + 1).cast("int"))
        return F.struct(
            (at["h"] * (1 << dims) + move.bitwiseAND(F.lit((1 << dims) - 1))).alias("h"), F.shiftright(move, dims).alias("s"), at["p"].alias("p")
        )

    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), packed, step, lambda at: at["h"])


def by_name(col: Column, bits: int = BITS) -> Column:
    """A name's cell: the top bits of its hash, so equal names share a cell and pruning by name keeps working; null is cell 0."""
    return F.when(col.isNull(), F.lit(0)).otherwise(F.shiftrightunsigned(F.xxhash64(col.cast("string")), 64 - bits)).cast("int")


def by_size(col: Column, bits: int = BITS, per_doubling: int = 3) -> Column:
    """A size's cell on a logarithmic scale, the same for every table; null, zero and less are cell 0."""
    cell = F.floor(F.log2(col.cast("double")) * per_doubling) + 1
    return F.when(col > 0, F.least(F.lit((1 << bits) - 1), F.greatest(cell, F.lit(0)))).otherwise(F.lit(0)).cast("int")


def curve_shards(df: DataFrame, cells: list[Column], ties: list[Column], shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """`df` with curve, shard and slot: rows in curve order, cut into runs whose row counts differ by one at most.

    `slot` numbers the rows of a shard from 0. Rows at one place of the curve follow `ties`; full ties (repeated rows)
    are in any order. Rows with nulls have cells of their own rule, so no row is lost; fewer rows than shards leave
    shards empty; an empty table gives no rows. Other columns stay; columns called like the new ones are replaced.

    Positions come from a range partitioning by (curve, ties): a place that holds a third of all rows is cut over many
    tasks by its ties, and no task or the driver sees more than its share.
    """
    keyed = df.drop("curve", "shard", "slot").withColumn("curve", hilbert_index(cells, bits))
    total = keyed.count()
    placed = with_positions(keyed, [], [F.col("curve"), *ties], "__position", one_task_bytes=-1)
    at = (F.col("__position") - 1).cast("long")
    shard = F.expr(f"(__position - 1) * {shards} div {max(total, 1)}").cast("int")
    begin = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).withColumn("slot", (at - begin).cast("long")).drop("__position")


def manifest(sharded: DataFrame, dimensions: list[str]) -> DataFrame:
    """One row per shard: rows, and least and greatest value of each dimension, by which a reader skips whole shards."""
    return sharded.groupBy("shard").agg(
        F.count("*").alias("rows"), *[f(d).alias(f"{n}_{d}") for d in dimensions for n, f in (("min", F.min), ("max", F.max))]
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order; a large shard is several files in that order, none made by one task alone."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
