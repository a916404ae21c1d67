"""Near-duplicate vectors by cosine: PCA-ordered tiles, leading dimensions first, residuals bounded by suffix norms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelytics.llm.graph import components
from parcelytics.llm.ngram_jaccard import _roots
from parcelytics.plans.scale import null_safe_join
from parcelytics.session import freeze

THRESHOLD = 0.93
#: Different vectors in a tile, and leading dimensions that are compared before the next bound is taken.
TILE, STEP = 1024, 16
#: Room for rounding in the bounds; the final test is in double precision on the vectors as they are given.
_SLACK = 1e-9


def _principal_axes(valid: DataFrame, dim: int) -> np.ndarray:
    """Eigenvectors of the second moments of the unit vectors, largest first; one dim x dim matrix reaches the driver."""

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dim, dim))
        for batch in batches:
            x = np.stack([np.frombuffer(v) for v in batch["vector"]])
            x = x / np.linalg.norm(x, axis=1)[:, None]
            total += x.T @ x
        at = np.arange(dim * dim)
        yield pd.DataFrame({"at": at, "s": total.ravel()})

    rows = valid.filter(F.col("dim") == dim).mapInPandas(moments, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()
    out = np.zeros(dim * dim)
    for r in rows:
        out[r["at"]] = r["s"]
    # rounding lets the sum depend on the order of tasks in its last digits; axes only order the work, not the result
    _, axes = np.linalg.eigh(out.reshape(dim, dim))
    return axes[:, ::-1]


def _link(threshold: float, step: int, shared):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key", kind="stable").reset_index(drop=True)
        side = rows["side"].to_numpy()
        same = bool((side == 2).all())
        raw = np.stack([np.frombuffer(v) for v in rows["vector"]])
        norm = np.linalg.norm(raw, axis=1)
        turned = (raw / norm[:, None]) @ shared.value[raw.shape[1]]
        left = np.arange(len(rows)) if same else np.flatnonzero(side == 0)
        right = left if same else np.flatnonzero(side == 1)
        a, b = turned[left], turned[right]
        dim = raw.shape[1]
        # tail[k]: norm of what stands behind the first k dimensions
        tail = lambda x: np.sqrt(np.maximum(np.concatenate([np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1], np.zeros((len(x), 1))], axis=1), 0))
        ta, tb = tail(a), tail(b)
        k = min(step, dim)
        partial = a[:, :k] @ b[:, :k].T
        alive = partial + ta[:, k][:, None] * tb[:, k][None, :] >= threshold - _SLACK
        if same:
            alive &= np.tri(len(left), dtype=bool).T & ~np.eye(len(left), dtype=bool)
        ia, ib = np.nonzero(alive)
        dot = partial[ia, ib]
        while k < dim and len(ia):
            to = min(k + step, dim)
            if len(ia) * 8 > len(left) * len(right):
                dot = dot + (a[:, k:to] @ b[:, k:to].T)[ia, ib]
            else:
                dot = dot + np.einsum("ij,ij->i", a[ia, k:to], b[ib, k:to])
            k = to
            on = dot + ta[ia, k] * tb[ib, k] >= threshold - _SLACK
            ia, ib, dot = ia[on], ib[on], dot[on]
        ia, ib = left[ia], right[ib]
        linked = np.zeros(len(ia), bool)
        for at in range(0, len(ia), 100_000):
            p, q = ia[at : at + 100_000], ib[at : at + 100_000]
            linked[at : at + 100_000] = np.einsum("ij,ij->i", raw[p], raw[q]) / (norm[p] * norm[q]) >= threshold
        ia, ib = ia[linked], ib[linked]
        copies = rows["copies"].to_numpy()
        links = np.zeros(len(rows), np.int64)
        np.add.at(links, ia, copies[ib])
        np.add.at(links, ib, copies[ia])
        on = np.flatnonzero(links)
        keys = rows["key"].to_numpy()
        return pd.DataFrame({"key": keys[on], "links": links[on], "root": keys[_roots(len(rows), ia, ib)[on]]})

    return run


def cosine_links(
    df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, tile: int = TILE, step: int = STEP
) -> DataFrame:
    """One row per row of `df`: vec_id, n_links, component_id, kept.

    Rows are compared when their labels are equal and not null; a pair is linked when its cosine in double precision is
    at least `threshold`. `n_links` counts the other rows linked directly (copies included), `component_id` is the
    smallest vec_id that links reach, `kept` marks the row that has it. A vector that is null, empty or zero or holds a
    null or non-finite component is linked with nothing, nor are vectors of different lengths; such a row is a component
    of its own. Rows whose vec_id is null take part, and a component of such rows alone has a null id; repeated rows
    count as they stand; other columns are ignored.

    Equal vectors of a label are one row with a count, so a group of copies costs nothing. A label's vectors are ordered
    by their first principal coordinate and cut into tiles; two tiles whose coordinates are too far apart are skipped.
    The tiles of a label meet in pairs, each in a task of its own, so a hot label is spread over many tasks.
    """
    x = F.col(vector).cast("array<double>")
    good = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    slim = df.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), x.alias("x"), (F.coalesce(good, F.lit(False)) & F.col(label).isNotNull()).alias("good"))

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["vector"] = [np.asarray(v, float).tobytes() if g else None for v, g in zip(batch.pop("x"), batch.pop("good"))]
            yield batch

    types = dict(slim.dtypes)
    rows = slim.mapInPandas(packed, f"vec_id {types['vec_id']}, label {types['label']}, vector binary")
    # -0.0 and 0.0 differ in their bytes: such vectors are near copies instead of copies, with the same links
    rows = freeze(rows.withColumn("key", F.unhex(F.md5(F.concat(F.col("label").cast("string").cast("binary"), F.lit("|").cast("binary"), "vector")))))
    members = rows.select("vec_id", "key")
    distinct = rows.filter("key IS NOT NULL").groupBy("key").agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("label").alias("label"), F.first("vector").alias("vector")
    ).withColumn("dim", (F.octet_length("vector") / 8).cast("int"))
    distinct = freeze(distinct)
    dims = [r["dim"] for r in distinct.select("dim").distinct().collect()]
    axes = {dim: _principal_axes(distinct, dim) for dim in dims}
    shared = df.sparkSession.sparkContext.broadcast(axes)

    @F.pandas_udf("double")
    def leading(v: pd.Series) -> pd.Series:
        out = np.empty(len(v))
        for i, raw in enumerate(v):
            u = np.frombuffer(raw)
            out[i] = u @ shared.value[len(u)][:, 0] / np.linalg.norm(u)
        return pd.Series(out)

    placed = freeze(distinct.withColumn("c", leading("vector")))
    tiled = _tiles(placed, tile)
    bounds = freeze(tiled.groupBy("label", "dim", "tile").agg(F.min("c").alias("lo"), F.max("c").alias("hi")))
    # unit vectors whose first coordinates differ by d have a cosine of at most 1 - d^2 / 2
    apart = (2 * (1 - threshold)) ** 0.5 + _SLACK
    other = bounds.select("label", "dim", F.col("tile").alias("j"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    pairs = bounds.withColumnRenamed("tile", "i").join(other, ["label", "dim"]).filter((F.col("i") <= F.col("j")) & (F.col("lo2") - F.col("hi") <= apart))
    one = F.col("i") == F.col("j")
    sides = F.when(one, F.array(F.struct(F.col("i").alias("tile"), F.lit(2).alias("side")))).otherwise(
        F.array(F.struct(F.col("i").alias("tile"), F.lit(0).alias("side")), F.struct(F.col("j").alias("tile"), F.lit(1).alias("side")))
    )
    tasks = pairs.withColumn("s", F.explode(sides)).select("label", "dim", "i", "j", "s.tile", "s.side")
    work = tasks.join(tiled, ["label", "dim", "tile"]).select("label", "dim", "i", "j", "side", "key", "copies", "vector")
    links = freeze(work.groupBy("label", "dim", "i", "j").applyInPandas(_link(threshold, step, shared), "key binary, links long, root binary"))
    roots = components(links, "key", "root").withColumnRenamed("node", "key")
    found = distinct.select("key", "copies", "least").join(links.groupBy("key").agg(F.sum("links").alias("links")), "key", "left").join(roots, "key", "left")
    found = found.select("key", "least", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "key").alias("root"))
    smallest = found.groupBy("root").agg(F.min("least").alias("component_id"))
    found = found.join(smallest, "root").select("key", "n_links", "component_id", F.lit(True).alias("valid"))
    out = members.join(found, "key", "left")
    own = F.col("valid").isNull()
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(own, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
        (own | F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))).alias("kept"),
    )


def _tiles(placed: DataFrame, tile: int) -> DataFrame:
    """`tile`: number of the row's tile in its label, along the first principal coordinate.

    A range partitioning by (label, dim, coordinate) cuts hot labels over tasks; rows are numbered inside a partition, and
    each partition starts a new tile, so no positions across partitions are needed.
    """
    laid = freeze(
        placed.repartitionByRange("label", "dim", "c", "key").sortWithinPartitions("label", "dim", "c", "key")
        .withColumn("pid", F.spark_partition_id()).withColumn("ix", F.monotonically_increasing_id())
    )
    first = laid.groupBy("label", "dim", "pid").agg(F.min("ix").alias("first"))
    with_first = null_safe_join(laid, first, ["label", "dim", "pid"], "inner")
    return with_first.withColumn("tile", F.col("pid") * F.lit(2**32) + F.floor((F.col("ix") - F.col("first")) / tile)).drop("pid", "ix", "first")
