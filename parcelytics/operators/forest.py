"""Cross-validated regression forests of large tables: rows that share the bins of all features are added up once, then trees grow on the sums.

A split depends on the rows only through the weights and weighted labels of the bins of each feature, so rows in the same cell (one bin
of every feature) count as one. A task draws the bootstrap weights of its rows, row by row, and adds them up per held-out fold, tree and
cell; all trees of all folds then grow together, one pass over the cells a level. Limits between bins, the bootstrap (Poisson with mean
1), the gain and the leaves are those of Spark's forest, with limits from all rows instead of some. Cells are bounded by the bins.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from parcelytics import fixed_values as fv
from parcelytics.operators import features as ft
from parcelytics.operators.boosting import BoostedTree
from parcelytics.plans.scale import maybe_broadcast, null_safe_join, with_positions
from parcelytics.session import freeze

#: Bins of a feature, different values up to which all of them are counted, and rows looked at first to tell features with more.
BINS, FEW, LOOK = 32, 1024, 100_000
#: Most cells; numbers a task holds to add up some folds, and at most for one fold; rows it takes at a time; groups of an encoding; folds.
CELLS, SUMS, MOST, ROWS, GROUPS, FOLDS = 2**22, 2**25, 2**26, 2**18, 2**20, 1000
GROUP_BYTES = 64 * 1024 * 1024


def limits_of(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """At most BINS - 1 limits midway between neighbouring values: all of them, or those next to equal shares of the weight."""
    values, at = np.unique(values, return_inverse=True)
    weights = np.bincount(at, weights, len(values))
    values, weights = values[weights > 0], weights[weights > 0]
    middle = (values[1:] + values[:-1]) / 2
    if len(middle) < BINS:
        return middle
    ends = np.cumsum(weights)
    both, chosen, i = ends[1:] + ends[:-1], [], 0
    for share in range(1, BINS):  # the limit before the value that passes the share farther than its forerunner misses it
        i = max(i, int(np.searchsorted(both, 2 * share * ends[-1] / BINS, "right")))
        if i == len(both):
            break
        chosen.append(middle[i])
        i += 1
    return np.array(chosen)


@dataclass
class Encoding:
    """Sums and numbers of labels per (fold, group): a group's smoothed mean over the folds that are neither held out nor a row's own."""

    sums: np.ndarray
    counts: np.ndarray
    missing: int  # the group of rows without one, unknown where it is held out

    def of(self, held: int, fold: np.ndarray, group: np.ndarray) -> np.ndarray:
        others = np.arange(len(self.sums)) != held
        total, number = self.sums[others].sum(0), self.counts[others].sum(0)
        mean = total.sum() / number.sum()
        own = fold != held
        rest = number[group] - np.where(own, self.counts[fold, group], 0)
        m = fv.ENCODING_SMOOTHING
        value = (total[group] - np.where(own, self.sums[fold, group], 0) + m * mean) / (rest + m)
        return np.where((rest == 0) | (~own & (group == self.missing)), mean, value)


@dataclass
class Forests:
    """What the tasks need: values of the fold column, places of the held-out ones, limits per held-out fold and feature, trees per fold."""

    folds: pa.Array
    held: list[int]
    limits: list[list[np.ndarray]]
    centre: float
    encoding: Encoding | None
    trees: list[list[BoostedTree]] = field(default_factory=list)

    @property
    def widths(self) -> list[int]:
        return [max(len(one[j]) + 1 for one in self.limits) for j in range(len(self.limits[0]))]

    @property
    def cells(self) -> int:
        return int(np.prod([float(w) for w in self.widths]))

    def codes(self, cell: np.ndarray) -> np.ndarray:
        return np.stack(np.unravel_index(cell, self.widths), 1)

    def shaped(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray | None]]:
        """(place of the fold, label, features, group) of ROWS rows at a time."""
        count = len(self.limits[0]) - (self.encoding is not None)
        for batch in gathered(batches):
            fold = pc.index_in(batch["fold"], value_set=self.folds).to_numpy().astype(np.int64)
            group = None if self.encoding is None else batch["group"].to_numpy().astype(np.int64)
            yield fold, batch["label"].to_numpy(), [batch[f"x{j}"].to_numpy() for j in range(count)], group

    def rows_of(self, i: int, fold: np.ndarray, x: list[np.ndarray], group: np.ndarray | None) -> list[np.ndarray]:
        """All features where the i-th held-out fold is left out."""
        return x if self.encoding is None else [*x, self.encoding.of(self.held[i], fold, group)]


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    some, rows = [], 0
    for batch in batches:
        some.append(batch)
        rows += len(batch)
        if rows >= ROWS:
            yield pa.Table.from_batches(some).combine_chunks()
            some, rows = [], 0
    if rows:
        yield pa.Table.from_batches(some).combine_chunks()


def _value_counts(rows: DataFrame, folds: list, count: int) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """Per feature: its values and rows per value and fold, or None where the values are many."""
    x, most = [F.col(f"x{j}") for j in range(count)], min(FEW, CELLS // (4 * len(folds)))
    first = rows.limit(LOOK).agg(*[F.approx_count_distinct(c).alias(f"d{j}") for j, c in enumerate(x)]).first()
    few = [j for j in range(count) if first[f"d{j}"] <= 2 * most]  # the others surely have more
    out: list[tuple[np.ndarray, np.ndarray] | None] = [None] * count
    if few:
        one = lambda j: rows.groupBy("fold", x[j].alias("value")).agg(F.count("*").alias("n")).select(F.lit(j).alias("feature"), "fold", "value", "n")
        table = reduce(DataFrame.unionAll, [one(j).limit(most * len(folds) + 1) for j in few]).toArrow()
        fold = pc.index_in(table["fold"], value_set=pa.array(folds).cast(table["fold"].type)).to_numpy()
        feature, value, n = (table[c].to_numpy() for c in ("feature", "value", "n"))
        if np.isnan(value).any():
            raise ValueError("a feature is NaN in some rows")
        for j in few:
            mine = feature == j
            values, at = np.unique(value[mine], return_inverse=True)
            numbers = np.zeros((len(values), len(folds)))
            numbers[at, fold[mine]] = n[mine]
            out[j] = (values, numbers) if len(values) <= most and mine.sum() <= most * len(folds) else None
    return out


def _limits(rows: DataFrame, forests: Forests, count: int) -> list[list[np.ndarray]]:
    """Per held-out fold and feature, from the rows of the other folds: of all values, or near equal shares where they are many."""
    values = _value_counts(rows, forests.folds.to_pylist(), count)
    folds = [forests.folds[h].as_py() for h in forests.held]
    many, shares = [j for j in range(count) if values[j] is None], [k / BINS for k in range(1, BINS)]
    near = rows.agg(*[F.percentile_approx(F.when(F.col("fold") != f, F.col(f"x{j}")), shares, 10_000).alias(f"q{i}_{j}") for j in many for i, f in enumerate(folds)],
                    *[F.count_if(F.isnan(f"x{j}")).alias(f"n{j}") for j in many]).first() if many else None
    if any(near[f"n{j}"] for j in many):
        raise ValueError("a feature is NaN in some rows")
    out = []
    for i, held in enumerate(forests.held):
        others = np.arange(len(forests.folds)) != held
        out.append([np.unique(near[f"q{i}_{j}"]) if one is None else limits_of(one[0], one[1][:, others].sum(1)) for j, one in enumerate(values)])
        if (code := forests.encoding) is not None:
            own = np.flatnonzero(others & (code.counts.sum(1) > 0))
            fold, group = np.repeat(own, code.counts.shape[1]), np.tile(np.arange(code.counts.shape[1]), len(own))
            out[-1].append(limits_of(code.of(held, fold, group), code.counts[own].ravel()))
    return out


def _cells(rows: DataFrame, forests: Forests, some: Sequence[int], trees: int, seed: int, scored: bool) -> DataFrame:
    """held, scored, cell, stats: for the rows of the other folds the bootstrap weights and weighted labels per tree; for those held out (if
    `scored`) number, sum of labels and of their squares. Labels count from the centre. One row per task and cell that has any.
    """
    size = forests.cells

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        sums, tests = np.zeros((len(some), 2 * trees, size)), np.zeros((len(some) if scored else 0, 3, size))
        for fold, label, x, group in forests.shaped(batches):
            y = label - forests.centre
            weights = rng.poisson(1.0, (trees, len(y))).astype(float)
            known: dict = {}
            for k, i in enumerate(some):
                cell = np.zeros(len(y), np.int64)
                for j, (column, limits, width) in enumerate(zip(forests.rows_of(i, fold, x, group), forests.limits[i], forests.widths)):
                    name = (j, limits.tobytes()) if j < len(x) else None
                    code = known.get(name)
                    if code is None:
                        code = np.searchsorted(limits, column)
                        if name:
                            known[name] = code
                    cell = cell * width + code
                train, held = np.flatnonzero(fold != forests.held[i]), np.flatnonzero(fold == forests.held[i])
                at, own = cell[train], y[train]
                for t in range(trees):
                    w = weights[t].take(train)
                    sums[k, t] += np.bincount(at, w, size)
                    sums[k, trees + t] += np.bincount(at, w * own, size)
                if scored:
                    at, own = cell[held], y[held]
                    for r, v in enumerate((None, own, own * own)):
                        tests[k, r] += np.bincount(at, v, size)
        for k, i in enumerate(some):
            for test, found, any_ in [(False, sums[k], sums[k, :trees].any(0))] + ([(True, tests[k], tests[k, 0] > 0)] if scored else []):
                cells = np.flatnonzero(any_)
                for at in range(0, len(cells), ROWS // 8):
                    part = cells[at : at + ROWS // 8]
                    stats = np.ascontiguousarray(found[:, part].T)
                    ends = np.arange(len(part) + 1, dtype=np.int32) * (8 * len(found))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(part), i), pa.int32()), pa.array(np.full(len(part), test)), pa.array(part, pa.int64()),
                        pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(ends), pa.py_buffer(stats)])], ["held", "scored", "cell", "stats"])

    cores = rows.sparkSession.sparkContext.defaultParallelism  # a task sends each cell once, so few tasks send little
    return freeze(rows.coalesce(cores).mapInArrow(summed, "held int, scored boolean, cell long, stats binary"))


def _by_fold(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(held-out fold, cells, their stats) of each batch."""
    for batch in batches:
        held = batch["held"].to_numpy()
        for i in np.unique(held):
            mine = batch.filter(pa.array(held == i))
            yield int(i), mine["cell"].to_numpy(), np.frombuffer(b"".join(mine["stats"].to_pylist())).reshape(len(mine), -1)


def best_split(hist: np.ndarray) -> tuple[int, int, float, float, float, float, float]:
    """(feature, bin, gain, weight and sum left, of the node) from features x bins x (weight, sum); the first of equals, feature -1 without gain."""
    left = np.cumsum(hist, axis=1)
    total = left[0, -1]
    right = total - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (left[..., 1] ** 2 / left[..., 0] + right[..., 1] ** 2 / right[..., 0] - total[1] ** 2 / total[0]) / total[0]
    gain[(left[..., 0] < 1) | (right[..., 0] < 1)] = -np.inf
    j, cut = np.unravel_index(np.argmax(gain), gain.shape)
    return (int(j) if gain[j, cut] > 0 else -1, int(cut), float(gain[j, cut]), *map(float, left[j, cut]), *map(float, total))


def _grow(cells: DataFrame, forests: Forests, some: Sequence[int], trees: int, depth: int) -> None:
    """Trees of the folds `some`: the splits of a level from the histograms of all tasks, which meet per node."""
    forests = replace(forests, encoding=None)  # with the same trees
    size, k = 2 ** (depth + 1) - 1, len(forests.widths)
    for i in some:
        forests.trees[i] = [BoostedTree(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size), np.zeros(size)) for _ in range(trees)]
    names = ["held", "tree", "node", "feature", "bin", "gain", "wl", "sl", "w", "s"]
    for level in range(depth):
        begin, nodes = 2**level - 1, 2**level

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hist: dict[int, np.ndarray] = {}
            for i, cell, stats in _by_fold(batches):
                sums, codes = hist.setdefault(i, np.zeros((trees, 2, nodes * k * BINS))), forests.codes(cell)
                places = np.arange(k) * BINS + codes
                for t in range(trees):
                    node = forests.trees[i][t].reach(codes, forests.trees[i][t].bin) - begin  # noqa: B023
                    here = node >= 0
                    at = (node[here, None] * (k * BINS) + places[here]).ravel()
                    for r in range(2):
                        sums[t, r] += np.bincount(at, np.repeat(stats[here, r * trees + t], k), nodes * k * BINS)  # noqa: B023
            part = TaskContext.get().partitionId()
            for i, sums in hist.items():
                by_node = np.moveaxis(sums.reshape(trees, 2, nodes, k * BINS), 1, 3)  # noqa: B023
                tree, node = np.nonzero(by_node[..., 0].any(2))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(tree), i), pa.int32()), pa.array(tree, pa.int32()), pa.array(node, pa.int32()), pa.array(np.full(len(tree), part), pa.int32()),
                    pa.array([by_node[t, n].tobytes() for t, n in zip(tree, node)], pa.binary())], ["held", "tree", "node", "part", "hist"])

        def chosen(table: pa.Table) -> pa.Table:
            ordered = table.sort_by("part")["hist"].to_pylist()  # the same order of additions in every run
            found = best_split(sum(np.frombuffer(h) for h in ordered).reshape(k, BINS, 2))
            kinds = [pa.int32()] * 2 + [pa.float64()] * 5
            return pa.table([*(table[c].slice(0, 1) for c in names[:3]), *(pa.array([v], kind) for v, kind in zip(found, kinds))], names)

        parts = cells.filter("NOT scored").mapInArrow(counted, "held int, tree int, node int, part int, hist binary")
        grown = False
        for r in parts.groupBy("held", "tree", "node").applyInArrow(chosen, "held int, tree int, node int, feature int, bin int, gain double, wl double, sl double, w double, s double").collect():
            tree, at = forests.trees[r["held"]][r["tree"]], begin + r["node"]
            if level == 0:
                tree.value[0] = r["s"] / r["w"]
            if r["feature"] >= 0:
                grown = True
                tree.feature[at], tree.bin[at], tree.limit[at] = r["feature"], r["bin"], forests.limits[r["held"]][r["feature"]][r["bin"]]
                tree.value[2 * at + 1], tree.value[2 * at + 2] = r["sl"] / r["wl"], (r["s"] - r["sl"]) / (r["w"] - r["wl"])
        if not grown:
            break


def cut(tree: BoostedTree, depth: int) -> BoostedTree:
    """The tree as it was when it had that depth."""
    feature = tree.feature.copy()
    feature[2**depth - 1 :] = -1
    return BoostedTree(feature, tree.bin, tree.limit, tree.value)


def grown(df: DataFrame, columns: Sequence[str], target: str, fold: str, group: str | None, held: Sequence | None, trees: int, depth: int, seed: int = 42,
          settings: Sequence[tuple[int, int]] = (), only: bool = False) -> tuple[Forests, DataFrame, list[list[float]]] | None:
    """(forests, rows, R2 per setting and fold) with one forest per held-out value of `fold` (all of them without `held`); None where the cells
    could be too many for a task. A setting (trees, depth) takes that many of the trees up to that depth.

    With `group`, the out-of-fold encoding of the label is the last feature. With `only`, there are no other folds than those held out.
    """
    label = F.col(target).cast("double")
    sums = [F.count("*").alias("n"), F.sum(label).alias("s"), F.count_if(label.isNull() | F.isnan(label)).alias("bad")]
    keys = [F.col(fold).alias("fold"), *([F.col(group).alias("group")] if group else [])]
    parts = freeze(df.groupBy(*keys).agg(*sums))
    found = parts.groupBy("fold").agg(*[F.sum(c).alias(c) for c in ("n", "s", "bad")]).limit(FOLDS + 1).collect()
    if sum(r["bad"] for r in found):
        raise ValueError(f"{target} is missing or NaN in some rows")
    if len(found) > FOLDS or any(r["fold"] is None for r in found):
        return None
    found.sort(key=lambda r: r["fold"])
    values = [r["fold"] for r in found]
    held = values if held is None else list(held)
    if only and set(values) - set(held):
        return None
    if len(values) < 2 or not set(held) <= set(values) or depth > 10:
        return None
    kind = df.schema[fold].dataType
    forests = Forests(pa.array(values, to_arrow_type(kind)), [values.index(h) for h in held], [], sum(r["s"] for r in found) / sum(r["n"] for r in found), None)
    shaped = df.select(*keys, label.alias("label"), *[c.alias(f"x{j}") for j, c in enumerate(ft.ordered_features(df, columns))])
    plain = shaped.drop("group")
    if group:
        groups = parts.select("group").distinct()
        if groups.limit(GROUPS + 1).count() > GROUPS:
            return None
        numbered = freeze(with_positions(groups, [], [F.col("group")], "number").select("group", (F.col("number") - 1).cast("int").alias("number")))
        shaped = null_safe_join(shaped, maybe_broadcast(numbered, GROUP_BYTES), ["group"]).drop("group").withColumnRenamed("number", "group")
        forests.encoding = _encoding(null_safe_join(parts, numbered, ["group"]), values)
    forests.limits = _limits(plain, forests, len(columns))
    per_fold = max(2 * trees * forests.cells, trees * 2**depth * len(forests.widths) * BINS)
    if forests.cells > CELLS or per_fold > MOST:
        return None
    forests.trees = [[] for _ in held]
    together, scores = max(1, SUMS // per_fold), [[0.0] * len(held) for _ in settings]
    for at in range(0, len(held), together):
        some = range(at, min(at + together, len(held)))
        cells = _cells(shaped, forests, some, trees, seed, bool(settings))
        _grow(cells, forests, some, trees, depth)
        for i, n, r2 in _r2(cells, forests, settings) if settings else []:
            scores[n][i] = r2
    return forests, shaped, scores


def _encoding(parts: DataFrame, values: list) -> Encoding:
    """Sums per fold and group on the driver: at most GROUPS groups."""
    table = parts.select(F.col("fold").alias("f"), F.col("number").alias("g"), "n", "s", F.col("group").isNull().alias("none")).toArrow()
    f = pc.index_in(table["f"], value_set=pa.array(values, table["f"].type)).to_numpy()
    g, none = table["g"].to_numpy(), table["none"].to_numpy()
    shape = (len(values), int(g.max()) + 1)
    sums, counts = np.zeros(shape), np.zeros(shape)
    sums[f, g], counts[f, g] = table["s"].to_numpy(), table["n"].to_numpy()
    return Encoding(sums, counts, int(g[none][0]) if none.any() else -1)


def _r2(cells: DataFrame, forests: Forests, settings: Sequence[tuple[int, int]]) -> list[tuple[int, int, float]]:
    """(held-out fold, setting, R2) from the cells of the rows held out."""
    forests = replace(forests, encoding=None)

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for i, cell, stats in _by_fold(batches):
            codes, (n, y, yy) = forests.codes(cell), stats.T
            for s, (trees, depth) in enumerate(settings):
                p = sum(t.value[t.reach(codes, t.bin)] for t in (cut(t, depth) for t in forests.trees[i][:trees])) / trees
                out.append((i, s, n.sum(), y.sum(), yy.sum(), (yy - 2 * p * y + n * p * p).sum()))
        columns = [*zip(*out)] if out else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k < 2 else pa.float64()) for k, c in enumerate(columns)], ["held", "setting", "n", "y", "yy", "error"])

    parts = cells.filter("scored").mapInArrow(errors, "held int, setting int, n double, y double, yy double, error double")
    found = parts.groupBy("held", "setting").agg(*[F.sum(c).alias(c) for c in ("n", "y", "yy", "error")]).collect()
    return [(r["held"], r["setting"], float(1 - np.float64(r["error"]) / (r["yy"] - r["y"] ** 2 / r["n"]))) for r in found]


def scores(forests: Forests, rows: DataFrame) -> DataFrame:
    """held (the fold as text), label, prediction: rows of the held-out folds under the forest of the other folds."""
    kept = F.array(*[F.lit(str(forests.folds[h].as_py())) for h in forests.held])

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fold, label, x, group in forests.shaped(batches):
            for i, held in enumerate(forests.held):
                own = fold == held
                if own.any():
                    part = forests.rows_of(i, fold[own], [c[own] for c in x], None if group is None else group[own])
                    codes = np.stack([np.searchsorted(limits, c) for limits, c in zip(forests.limits[i], part)], 1).astype(np.uint8)
                    value = sum(t.value[t.reach(codes, t.bin)] for t in forests.trees[i]) / len(forests.trees[i]) + forests.centre
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), i), pa.int32()), pa.array(label[own]), pa.array(value)], ["held", "label", "prediction"])

    found = rows.mapInArrow(predicted, "held int, label double, prediction double")
    return found.select(F.element_at(kept, F.col("held") + 1).alias("held"), "label", "prediction")
