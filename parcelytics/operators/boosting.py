"""Second-order boosted regression trees: histograms of gradient and curvature per node are added up over the partitions.

Every level of a tree is one pass over the binned rows. A task adds its rows to one histogram a feature, the histograms of a feature
meet in one task (in steps, so that it never holds many), which returns the best split of every open node; the driver only sees
one row per node and feature.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelytics.session import freeze

#: Histograms of a feature that one task adds up, and trees after which the margins of the rows are written anew.
TOGETHER, WRITTEN_EVERY = 32, 10


@dataclass
class BoostedTree:
    """Nodes numbered as in a heap (children of n: 2n + 1 and 2n + 2): feature (-1: leaf), bin and limit of the split, value of a leaf."""

    feature: np.ndarray
    bin: np.ndarray
    limit: np.ndarray
    value: np.ndarray

    def reach(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The node that each row (bin codes or feature values, with `at` the matching bounds) ends in."""
        node = np.zeros(len(rows), np.int64)
        while len(open_rows := np.flatnonzero(self.feature[node] >= 0)):
            n = node[open_rows]
            node[open_rows] = 2 * n + 2 - (rows[open_rows, self.feature[n]] <= at[n])
        return node


@dataclass
class BoostedModel:
    base: float
    trees: list[BoostedTree] = field(default_factory=list)

    def values(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += tree.value[tree.reach(x, tree.limit)]
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """`df` (with a vector column `features`) and its `prediction`."""
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield pd.Series(shared.value.values(np.stack(batch.to_list())) if len(batch) else np.empty(0))

        return df.withColumn("prediction", predicted(vector_to_array(F.col("features"))))


def _codes(table: pa.RecordBatch) -> np.ndarray:
    data = table["codes"]
    return np.frombuffer(b"".join(data.to_pylist()), np.uint8).reshape(len(data), -1) if len(data) else np.empty((0, 0), np.uint8)


def best_splits(hist: np.ndarray, l2: float, least: float, gamma: float) -> list[tuple]:
    """(node, bin, gain, gradient and curvature left, of the node) of the best split per node; `hist` is nodes x bins x 2. Ties: the lowest bin."""
    left = np.cumsum(hist, axis=1)
    total = left[:, -1:, :]
    right = total - left
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + l2)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (score(left) + score(right) - score(total)) / 2 - gamma
    gain[(left[..., 1] < least) | (right[..., 1] < least) | ~np.isfinite(gain)] = -np.inf
    cut = np.argmax(gain, axis=1)
    return [(n, int(c), float(gain[n, c]), *map(float, left[n, c]), *map(float, total[n, 0])) for n, c in enumerate(cut)]


@dataclass
class SecondOrderBooster:
    """Squared error; shrinkage `rate`, L2 on leaf values, least curvature (rows) of a child, least gain `gamma`, shares of columns and rows a tree."""

    rounds: int = 100
    depth: int = 6
    rate: float = 0.1
    l2: float = 1.0
    least: float = 1.0
    gamma: float = 0.0
    column_share: float = 1.0
    row_share: float = 1.0
    bins: int = 256
    seed: int = 42

    def fit(self, shaped: DataFrame) -> BoostedModel:
        """The model of a table with the vector column `features` and `label`. Rows without a label are left out; no rows give the value 0."""
        rows = shaped.filter("label IS NOT NULL").select(vector_to_array(F.col("features")).alias("x"), F.col("label").cast("double").alias("y"))
        first = rows.first()
        if first is None:
            return BoostedModel(0.0)
        n = len(first["x"])
        shares = [k / self.bins for k in range(1, self.bins)]
        bounds = rows.agg(F.avg("y").alias("base"), *[F.percentile_approx(F.col("x")[i], shares, 10_000).alias(f"b{i}") for i in range(n)]).first()
        edges = [np.unique(bounds[f"b{i}"]) for i in range(n)]
        model = BoostedModel(bounds["base"])
        binned = freeze(self._binned(rows, edges, model.base))
        rng = random.Random(self.seed)
        new: list[BoostedTree] = []
        for round_no in range(self.rounds):
            columns = sorted(rng.sample(range(n), max(1, round(self.column_share * n))))
            new.append(self._grow(binned, new, columns, edges, round_no))
            model.trees.append(new[-1])
            if len(new) == WRITTEN_EVERY and round_no + 1 < self.rounds:
                binned = freeze(self._with_margins(binned, new))
                new = []
        return model

    def _binned(self, rows: DataFrame, edges: list[np.ndarray], base: float) -> DataFrame:
        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.array(batch["x"].to_pylist(), float).reshape(len(batch), len(edges))
                codes = np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(edges)], 1).astype(np.uint8)
                kept = [batch["y"], batch["draw"], pa.array(np.full(len(x), base))]
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes() for c in codes], pa.binary()), *kept], ["codes", "y", "draw", "margin"])

        return rows.withColumn("draw", F.xxhash64("x", "y")).mapInArrow(coded, "codes binary, y double, draw long, margin double")

    @staticmethod
    def _with_margins(binned: DataFrame, trees: list[BoostedTree]) -> DataFrame:
        def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes, margin = _codes(batch), batch["margin"].to_numpy().copy()
                for tree in trees if len(batch) else []:
                    margin += tree.value[tree.reach(codes, tree.bin)]
                yield pa.RecordBatch.from_arrays([batch["codes"], batch["y"], batch["draw"], pa.array(margin)], ["codes", "y", "draw", "margin"])

        return binned.mapInArrow(moved, binned.schema)

    def _grow(self, binned: DataFrame, before: list[BoostedTree], columns: list[int], edges: list[np.ndarray], round_no: int) -> BoostedTree:
        size = 2 ** (self.depth + 1) - 1
        tree = BoostedTree(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size), np.zeros(size))
        for level in range(self.depth):
            begin = 2**level - 1
            best: dict[int, tuple] = {}
            for r in self._splits(binned, before, tree, columns, level, round_no).collect():
                if r["gain"] > 1e-12 and (r["node"] not in best or (-r["gain"], r["feature"]) < (-best[r["node"]]["gain"], best[r["node"]]["feature"])):
                    best[r["node"]] = r
                if level == 0:
                    tree.value[0] = -self.rate * r["g"] / (r["h"] + self.l2) if r["h"] + self.l2 else 0.0
            for node, r in best.items():
                at = begin + node
                tree.feature[at], tree.bin[at], tree.limit[at] = r["feature"], r["bin"], edges[r["feature"]][r["bin"]]
                for child, g, h in ((2 * at + 1, r["gl"], r["hl"]), (2 * at + 2, r["g"] - r["gl"], r["h"] - r["hl"])):
                    tree.value[child] = -self.rate * g / (h + self.l2)
            if not best:
                break
        return tree

    def _splits(self, binned: DataFrame, before: list[BoostedTree], tree: BoostedTree, columns: list[int], level: int, round_no: int) -> DataFrame:
        """node (of the level), feature, bin, gain, gl, hl, g, h: the best split of each node by each feature."""
        begin, nodes = 2**level - 1, 2**level
        bins, share, l2, least, gamma = self.bins, self.row_share, self.l2, self.least, self.gamma

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hist = np.zeros((len(columns), nodes * bins, 2))
            for batch in batches:
                codes, draw = _codes(batch), batch["draw"].to_numpy()
                if not len(codes):
                    continue
                gradient = batch["margin"].to_numpy() - batch["y"].to_numpy()
                for t in before:
                    gradient += t.value[t.reach(codes, t.bin)]
                node = tree.reach(codes, tree.bin) - begin
                drawn = node >= 0
                if share < 1:
                    mixed = (draw.astype(np.uint64) ^ np.uint64(round_no * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xFF51AFD7ED558CCD)
                    drawn &= (mixed >> np.uint64(11)) < np.uint64(int(share * 2**53))
                for k, c in enumerate(columns):
                    cell = node[drawn] * bins + codes[drawn, c]
                    hist[k, :, 0] += np.bincount(cell, gradient[drawn], nodes * bins)
                    hist[k, :, 1] += np.bincount(cell, minlength=nodes * bins)
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns, pa.int32()), pa.array([part] * len(columns), pa.int64()), pa.array([h.tobytes() for h in hist], pa.binary())], ["feature", "part", "hist"])

        def added(table: pa.Table) -> np.ndarray:
            ordered = table.sort_by("part")  # the same order of additions in every run
            return sum(np.frombuffer(h) for h in ordered["hist"].to_pylist())

        def together(table: pa.Table) -> pa.Table:
            return pa.table({"feature": table["feature"][:1], "part": pa.array([min(table["part"].to_pylist()) // TOGETHER]), "hist": pa.array([added(table).tobytes()], pa.binary())})

        def chosen(table: pa.Table) -> pa.Table:
            found = best_splits(added(table).reshape(nodes, bins, 2), l2, least, gamma)
            names = ["node", "bin", "gain", "gl", "hl", "g", "h"]
            columns_of = [pa.array(c, pa.int32() if n in ("node", "bin") else pa.float64()) for n, c in zip(names, zip(*found))]
            return pa.table([pa.array([table["feature"][0].as_py()] * nodes, pa.int32()), *columns_of], ["feature", *names])

        parts = binned.mapInArrow(counted, "feature int, part long, hist binary")
        count = binned.rdd.getNumPartitions()
        while count > TOGETHER:
            parts = parts.groupBy("feature", F.floor(F.col("part") / TOGETHER).alias("__to")).applyInArrow(together, "feature int, part long, hist binary")
            count = -(-count // TOGETHER)
        return parts.groupBy("feature").applyInArrow(chosen, "feature int, node int, bin int, gain double, gl double, hl double, g double, h double")
