"""Exact attributions of Spark's tree models: Shapley values of the path-dependent expectation, for many rows at once.

A leaf is reached with known features S with the weight that S lets through: a feature in S counts 1 or 0, as the row passes its
splits or not, a feature outside S the share of training rows that passed. The weights of all S of one size are the coefficients of
a polynomial with one factor a feature, extended along the path and unwound by one factor for the feature under question.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelytics.operators import features as ft
from parcelytics.session import FROZEN, ensure_checkpoint_dir

#: Most nodes of a model that is sent to all tasks (some hundred bytes each), rows that a task explains at a time, and features
#: of a path up to which a leaf's shares are worked out once per pattern of passed features.
NODES, ROWS, PATTERNS = 500_000, 10_000, 10


@dataclass
class Leaf:
    """A leaf's value, and for every feature on its path the share of training rows that passed and its (node, to the left) steps."""

    value: float
    path: list[tuple[int, float, list[tuple[int, bool]]]]


@dataclass
class Tree:
    """Splits by node number: (feature, threshold or None, left categories); the leaves; the weight in the model."""

    splits: dict[int, tuple[int, float | None, list[float]]]
    leaves: list[Leaf]
    weight: float

    def passes(self, x: np.ndarray) -> dict[int, np.ndarray]:
        """Whether each row goes left at each node."""
        return {n: (x[:, f] <= t if t is not None else np.isin(x[:, f], left)) for n, (f, t, left) in self.splits.items()}


def _tree(nodes: dict[int, dict], weight: float) -> Tree:
    splits, leaves = {}, []
    todo = [(0, {})]
    while todo:
        at, path = todo.pop()
        node = nodes[at]
        if node["leftChild"] < 0:
            leaves.append(Leaf(node["prediction"], [(f, share, steps) for f, (share, steps) in path.items()]))
            continue
        split = node["split"]
        feature, values = split["featureIndex"], list(split["leftCategoriesOrThreshold"])
        splits[at] = (feature, values[0], []) if split["numCategories"] < 0 else (feature, None, values)
        for child, left in ((node["leftChild"], True), (node["rightChild"], False)):
            share, steps = path.get(feature, (1.0, []))
            passed = nodes[child]["impurityStats"][0] / node["impurityStats"][0]
            todo.append((child, {**path, feature: (share * passed, [*steps, (at, left)])}))
    return Tree(splits, leaves, weight)


def read_trees(model, spark) -> list[Tree]:
    """The trees of a fitted decision tree, forest or boosted model, as it is saved. What reaches the driver is the model."""
    path = f"{ensure_checkpoint_dir(spark)}/model-{uuid.uuid4().hex}"
    model.write().save(path)
    FROZEN.append(path)
    single = not hasattr(model, "treeWeights")
    weights = [1.0] if single else list(model.treeWeights)
    if not single and type(model).__name__.startswith("RandomForest"):
        weights = [w / sum(weights) for w in weights]
    saved = spark.read.parquet(f"{path}/data")
    flat = saved.select(F.lit(0).alias("treeID"), *saved.columns) if single else saved.select("treeID", "nodeData.*")
    if flat.count() > NODES:
        raise ValueError(f"the model has more than {NODES} nodes")
    trees: dict[int, dict[int, dict]] = {}
    for row in flat.select("treeID", "id", "prediction", "impurityStats", "leftChild", "rightChild", "split").collect():
        trees.setdefault(row["treeID"], {})[row["id"]] = row.asDict(recursive=True)
    return [_tree(nodes, weights[k]) for k, nodes in sorted(trees.items())]


def _leaf_shares(leaf: Leaf, share: np.ndarray, value: float, one: np.ndarray) -> list[np.ndarray]:
    """What the leaf adds to the attribution of each feature of its path, per column of `one` (1 where the feature's steps are passed)."""
    m, n = one.shape
    weights = np.zeros((m + 1, n))  # row k: weight of all sets of k known features together
    weights[0] = 1.0
    for j in range(m):
        weights[1 : j + 2] = weights[1 : j + 2] * share[j] + weights[: j + 1] * one[j]
        weights[0] *= share[j]
    orders = [factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)]
    out = []
    for j, (_, z, _) in enumerate(leaf.path):
        passed, rest, total = one[j] > 0, weights[m], np.zeros(n)
        for k in range(m - 1, -1, -1):  # unwind the factor (z + one * t), from the highest power or, where one is 0, each by itself
            total += orders[k] * np.where(passed, rest, weights[k] / z)
            rest = weights[k] - z * rest
        out.append(value * (one[j] - z) * total)
    return out


def explain(trees: Sequence[Tree], x: np.ndarray) -> tuple[np.ndarray, float]:
    """(attributions of every row and feature, base): each row's attributions and the base add up to the model's prediction."""
    phi, base = np.zeros(x.shape), 0.0
    for tree in trees:
        left = tree.passes(x)
        for leaf in tree.leaves:
            value, m = tree.weight * leaf.value, len(leaf.path)
            share = np.array([z for _, z, _ in leaf.path])
            base += value * share.prod()
            if not m:
                continue
            code, passed = np.zeros(len(x), np.int64), []
            for j, (_, _, steps) in enumerate(leaf.path):
                through = np.logical_and.reduce([left[node] == to_left for node, to_left in steps])
                passed.append(through)
                if m <= PATTERNS:
                    code += through.astype(np.int64) << j
            if m <= PATTERNS and 2**m < len(x):  # rows that pass the same features of the path have the same shares of the leaf
                each = (np.arange(2**m) >> np.arange(m)[:, None] & 1).astype(float)
                shares = [c[code] for c in _leaf_shares(leaf, share, value, each)]
            else:
                shares = _leaf_shares(leaf, share, value, np.array(passed, float))
            for (feature, _, _), part in zip(leaf.path, shares):
                phi[:, feature] += part
    return phi, base


def tree_attributions(model, df: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Exact attributions per row: key, feature, value, phi, prediction, base, residual (prediction - base - sum of phi).

    `model` is a Spark decision tree, forest or boosted regressor over `columns`; missing features count as 0, as in training.
    The base is the mean prediction by the shares of training rows at each node. Repeated keys keep their own rows each.
    """
    shared = df.sparkSession.sparkContext.broadcast(read_trees(model, df.sparkSession))

    @F.arrow_udf("phi array<double>, base double")
    def explained(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trees, width = shared.value, len(columns)
        for batch in batches:
            x, parts = batch.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), width), []
            base = 0.0
            for at in range(0, len(x), ROWS):
                phi, base = explain(trees, x[at : at + ROWS])
                parts.append(phi.ravel())
            flat = pa.array(np.concatenate(parts) if parts else np.empty(0))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * width), flat)
            yield pa.StructArray.from_arrays([lists, pa.array(np.full(len(x), base))], ["phi", "base"])

    shaped = df.select(*key, F.array(*ft.ordered_features(df, columns)).alias("x"))
    scored = model.transform(shaped.withColumn("features", array_to_vector(F.col("x")))).select(*key, "x", "prediction")
    done = scored.withColumn("e", explained("x"))
    residual = F.col("prediction") - F.col("e.base") - F.aggregate("e.phi", F.lit(0.0), lambda a, v: a + v)
    names = F.array(*[F.lit(c) for c in columns])
    each = F.transform("x", lambda v, i: F.struct(F.get(names, i).alias("feature"), v.alias("value"), F.get(F.col("e.phi"), i).alias("phi")))
    rows = done.select(*key, "prediction", F.col("e.base").alias("base"), residual.alias("residual"), F.explode(each).alias("c"))
    return rows.select(*key, "c.feature", "c.value", "c.phi", "prediction", "base", "residual")
