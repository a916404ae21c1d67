"""Median over round neighbourhoods of a grid: tiles with a halo, and a histogram that moves along the rows of a tile."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least side of a tile in cells, and values that one coarse bin of a histogram covers.
SIDE, COARSE = 64, 64


def _kth(fine: np.ndarray, coarse: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Code of the k-th smallest (from 0) member of each row's histogram: first its coarse bin, then its place in that."""
    row = np.arange(len(k))
    sums = np.cumsum(coarse, axis=1)
    block = np.argmax(sums > k[:, None], axis=1)
    left = k - np.where(block > 0, sums[row, np.maximum(block - 1, 0)], 0)
    inner = np.cumsum(fine.reshape(len(k), -1, COARSE)[row, block], axis=1)
    return block * COARSE + np.argmax(inner > left[:, None], axis=1)


def disc_medians(layers: np.ndarray, radius: float) -> np.ndarray:
    """Median of the values within `radius` of each inner cell of `layers` (k, rows, columns; NaN: none), of all k layers.

    Inner cells are those whose whole disc lies in the array. All inner rows move together: a step to the right takes in the cells
    on the right edge of the disc and gives up those on the left, one per row of the disc. Cells without any value get NaN.
    """
    reach = int(radius)
    _, height, width = layers.shape
    rows, columns = height - 2 * reach, width - 2 * reach
    out = np.full((rows, columns), np.nan)
    known = ~np.isnan(layers)
    values, codes = np.unique(layers[known], return_inverse=True)
    if not len(values):
        return out
    bins = -(-len(values) // COARSE)
    code = np.full(layers.shape, -1)
    code[known] = codes
    fine, coarse, count = np.zeros((rows, bins * COARSE), np.int32), np.zeros((rows, bins), np.int32), np.zeros(rows, np.int64)
    offset = np.arange(-reach, reach + 1)
    half = np.floor(np.sqrt(np.maximum(radius * radius - offset * offset, 0))).astype(int)
    middle = np.arange(rows)[:, None] + reach + offset  # rows of the array that the disc around each inner row covers
    owner = np.broadcast_to(np.arange(rows)[:, None], middle.shape)

    def change(column: np.ndarray, by: int) -> None:
        here = column >= 0
        found = code[:, middle[:, here], np.broadcast_to(column, middle.shape)[:, here]]
        who = np.broadcast_to(owner[:, here], found.shape)[found >= 0]
        found = found[found >= 0]
        np.add.at(fine, (who, found), by)
        np.add.at(coarse, (who, found // COARSE), by)
        np.add.at(count, who, by)

    for column in range(-2 * reach, columns):  # until column 0 the disc only fills
        at = column + reach
        change(np.where(at + half < width, at + half, -1), 1)
        change(at - half - 1, -1)
        if column >= 0:
            some = np.flatnonzero(count)
            if len(some):
                low, high = ((values[_kth(fine[some], coarse[some], (count[some] - d) // 2)]) for d in (1, 0))
                out[some, column] = (low + high) / 2
    return out


def focal_medians(grid: DataFrame, value: str, radius: float, out: str) -> DataFrame:
    """(x, y, out) for every cell (integer x, y) of `grid`: the median of the values not farther than `radius` cells.

    A cell goes to its own tile and, near a border, to the (at most three) tiles next to it; a task holds one tile with its halo.
    """
    reach = int(radius)
    side = max(SIDE, 4 * reach)
    around = lambda c: F.sequence(F.floor((F.col(c) - reach) / side), F.floor((F.col(c) + reach) / side))
    cells = grid.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col(value).cast("double").alias("v"))
    cells = cells.filter("x IS NOT NULL AND y IS NOT NULL")
    sent = cells.select("x", "y", "v", F.explode(around("x")).alias("tx")).select("x", "y", "v", "tx", F.explode(around("y")).alias("ty"))

    def medians(table: pa.Table) -> pa.Table:
        left, top = (table[c][0].as_py() * side for c in ("tx", "ty"))
        x, y, v = (table[c].to_numpy() for c in ("x", "y", "v"))
        # a repeated cell counts as often as it occurs: each occurrence in a layer of its own
        layer = pd.Series(x).groupby([x, y]).cumcount().to_numpy()
        layers = np.full((layer.max() + 1, side + 2 * reach, side + 2 * reach), np.nan)
        layers[layer, y - top + reach, x - left + reach] = v
        own = (layer == 0) & (x >= left) & (x < left + side) & (y >= top) & (y < top + side)
        found = disc_medians(layers, radius)[y[own] - top, x[own] - left]
        return pa.table([pa.array(x[own]), pa.array(y[own]), pa.array(found, mask=np.isnan(found))], ["x", "y", out])

    return sent.groupBy("tx", "ty").applyInArrow(medians, f"x long, y long, {out} double")
