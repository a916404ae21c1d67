"""Median over discs against a plain loop."""

from __future__ import annotations

import math
import random
import statistics

import numpy as np
import pytest

from parcelytics.operators import pixels
from parcelytics.plans import focal


def plain(rows, radius):
    out = {}
    for x, y, _ in rows:
        near = [v for a, b, v in rows if v is not None and (a - x) ** 2 + (b - y) ** 2 <= radius * radius]
        out[x, y] = statistics.median(near) if near else None
    return out


@pytest.mark.parametrize("radius", [0, 1, 1.5, 2, 5, 20])
def test_tiles_and_borders(spark, radius):
    """Cells on both sides of tile borders and of zero, holes, missing values, repeated cells, ties."""
    rng = random.Random(int(radius * 2))
    cells = {(rng.randrange(-8, 9) + rng.choice([0, 60, 64]), rng.randrange(-8, 9)) for _ in range(260)} | {(500, 500)}
    rows = [(x, y, rng.choice([None, float(rng.randrange(12)), rng.random()])) for x, y in cells]
    rows += [(*rng.choice(sorted(cells)), 3.25) for _ in range(15)]
    found = pixels.focal_median(spark.createDataFrame(rows, "x int, y int, v double"), "v", radius).collect()
    want = plain(rows, radius)
    assert len(found) == len(rows)
    assert all((f["focal_v"] is None) == (want[f["x"], f["y"]] is None) for f in found)
    assert all(f["focal_v"] is None or math.isclose(f["focal_v"], want[f["x"], f["y"]], abs_tol=1e-12) for f in found)


def test_empty_grid(spark):
    assert pixels.focal_median(spark.createDataFrame([], "x int, y int, v double"), "v", 2).collect() == []


def test_histogram_moves_exactly():
    rng = np.random.default_rng(2)
    grid = rng.normal(size=(1, 60, 60))
    grid[0, rng.random((60, 60)) < 0.2] = np.nan
    found = focal.disc_medians(grid, 9)
    y, x = np.mgrid[:60, :60]
    for r, c in rng.integers(0, 42, (60, 2)):
        disc = (y - r - 9) ** 2 + (x - c - 9) ** 2 <= 81
        assert found[r, c] == pytest.approx(np.nanmedian(grid[0][disc]))
