"""Exact areas under polygons against closed forms, other cell sizes and dense samples."""

from __future__ import annotations

import numpy as np
import pytest

from parcelytics.operators import spatial
from parcelytics.plans import overlay

RINGS = "array<array<struct<lon: double, lat: double>>>"


def star(rng, n, centre, reach):
    angle = np.sort(rng.random(n)) * 2 * np.pi
    far = reach * (0.3 + 0.7 * rng.random(n))
    return np.stack([centre[0] + far * np.cos(angle), centre[1] + far * np.sin(angle)], 1)


def within(points, ring):
    x, y = points.T
    out = np.zeros(len(points), bool)
    for (x1, y1), (x2, y2) in zip(ring, np.roll(ring, -1, 0)):
        if y1 != y2:
            out ^= ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_areas_do_not_depend_on_cells(seed):
    rng = np.random.default_rng(seed)
    unit = [star(rng, 12, (0, 0), 1), star(rng, 7, (0.5, 0.2), 0.6)]  # overlapping parts count once
    layers = [[star(rng, 9, rng.random(2), 0.7) for _ in range(5)], [star(rng, 40, rng.random(2) - 0.5, 0.9) for _ in range(8)]]
    whole = overlay.areas_within(unit, layers)
    for size in (0.37, 0.11):
        cells = {}
        for k, rings in enumerate([unit, *layers]):
            for ring in rings:
                for column, row, piece in overlay.cell_pieces(ring, size):
                    cells.setdefault((column, row), [[], [], []])[k].append(piece)
        assert np.allclose(sum(overlay.areas_within(c[0], c[1:]) for c in cells.values()), whole, atol=1e-11)
    points = rng.random((60000, 2)) * 3 - 1.5
    hit = np.any([within(points, r) for r in unit], 0)
    sampled = [hit.mean() * 9, *[(hit & np.any([within(points, r) for r in layer], 0)).mean() * 9 for layer in layers]]
    assert np.allclose(sampled, whole, atol=0.06)


def rings(*shapes):
    return [[{"lon": float(x), "lat": float(y)} for x, y in shape] for shape in shapes]


def test_areal_share_defined_cases(spark):
    square = [(0, 0), (2, 0), (2, 2), (0, 2)]
    units = spark.createDataFrame([
        ("half covered", rings(square)), ("outside", rings([(10, 10), (11, 10), (11, 11), (10, 11)])), ("no area", rings([(0, 0), (1, 1)])),
        ("no rings", []), ("missing", None), ("two parts", rings(square, [(10, 10), (12, 10), (12, 12), (10, 12)])), (None, rings(square)),
    ], f"k string, rings {RINGS}")
    cover = spark.createDataFrame([(rings([(0, 0), (1, 0), (1, 2), (0, 2)]),)] * 3 + [(rings([(0.5, -1), (1, -1), (1, 5), (0.5, 5)]),)], f"rings {RINGS}")
    flood = spark.createDataFrame([(rings([(0, 0), (2, 0), (0, 2)]),), (rings([(10, 10), (10.5, 10), (10.5, 11), (10, 11)]),)], f"rings {RINGS}")
    found = {r["k"]: (round(r["covered"], 9), round(r["flooded_share"], 9)) for r in spatial.areal_share(units, "k", cover, flood, 0.7).collect()}
    assert found == {"half covered": (0.5, 0.5), "outside": (0.0, 0.0), "two parts": (0.25, 0.3125)}  # flooded counts over the whole unit
    assert spatial.areal_share(units.limit(0), "k", cover, flood).collect() == []
    dry = spatial.areal_share(units, "k", cover.limit(0), flood).collect()
    assert {(r["covered"], r["flooded_share"]) for r in dry} == {(0.0, 0.0)}


def test_units_of_a_full_cell_are_dealt_over_tasks_with_the_same_areas(spark, monkeypatch):
    square = lambda x, y, s: [[{"lon": a, "lat": b} for a, b in ((x, y), (x + s, y), (x + s, y + s), (x, y + s))]]
    schema = "k long, rings array<array<struct<lon:double,lat:double>>>"
    units = spark.createDataFrame([(i, square(0.001 * (i % 37), 0.0007 * (i % 41), 0.01 + 0.0001 * (i % 5))) for i in range(300)], schema)
    layer = spark.createDataFrame([(i, square(0.02 * i, 0.01 * (i % 2), 0.015)) for i in range(4)], schema)
    whole = {r["k"]: r for r in overlay.overlay_areas(units, "k", [layer], 0.05).collect()}
    monkeypatch.setattr(overlay, "CELL_PIECES", 10)
    plan = overlay.overlay_areas(units, "k", [layer], 0.05)._jdf.queryExecution().optimizedPlan().toString()
    assert "part#" in plan  # a cell is more than one group
    dealt = {r["k"]: r for r in overlay.overlay_areas(units, "k", [layer], 0.05).collect()}
    assert len(dealt) == 300 and whole.keys() == dealt.keys()
    for k, row in dealt.items():
        assert np.allclose(tuple(row), tuple(whole[k]), atol=1e-15)
        side = 0.01 + 0.0001 * (k % 5)
        x, y = 0.001 * (k % 37), 0.0007 * (k % 41)
        under = sum(max(0, min(x + side, a + 0.015) - max(x, a)) * max(0, min(y + side, b + 0.015) - max(y, b)) for a, b in ((0.02 * i, 0.01 * (i % 2)) for i in range(4)))
        assert abs(row["area"] - side * side) < 1e-12 and abs(row["under_0"] - under) < 1e-12


def flat(rings):
    return np.concatenate([np.empty((0, 2)), *rings]), np.array([len(r) for r in rings], np.int64)


@pytest.mark.parametrize("points", [2**16, 40])
def test_rings_cut_together_give_the_pieces_of_each(points, monkeypatch):
    monkeypatch.setattr(overlay, "POINTS", points)  # with few points at once, large rings go cell by cell
    rng = np.random.default_rng(3)
    shapes = [star(rng, int(rng.integers(3, 9)), rng.random(2) * 4 - 2, rng.random()) for _ in range(60)]
    shapes += [np.array([(0.0, 0.0), (1.0, 1.0)]), np.empty((0, 2)), np.array([(-0.25, 0.25), (0.5, 0.25), (0.5, 0.5), (-0.25, 0.5)]), star(rng, 30, (0, 0), 3)]
    expected = [(n, c, r, p.tobytes()) for n, ring in enumerate(shapes) for c, r, p in overlay.cell_pieces(ring, 0.25)]
    found = []
    for number, column, row, p, sizes in overlay._cut(*flat(shapes), 0.25):
        found += [(int(n), int(c), int(r), part.tobytes()) for n, c, r, part in zip(number, column, row, np.split(p, np.cumsum(sizes)[:-1]))]
    assert sorted(found) == sorted(expected)


@pytest.mark.parametrize("numbers, edges", [(2**18, 160), (200, 160), (2**18, 30)])
def test_units_swept_together_have_the_areas_of_each(numbers, edges, monkeypatch):
    monkeypatch.setattr(overlay, "NUMBERS", numbers)
    monkeypatch.setattr(overlay, "EDGES", edges)  # beyond it a unit goes alone and is cut in four
    rng = np.random.default_rng(4)
    unit = rng.permutation(np.concatenate([np.arange(50), rng.integers(0, 50, 20)]))
    own = [star(rng, int(rng.integers(3, 8)), rng.random(2) * 3, 0.4) for _ in unit]
    layer = rng.integers(0, 2, 40)
    covers = [star(rng, int(rng.integers(3, 12)), rng.random(2) * 3, 0.5) for _ in layer]
    covers[:3], layer[:3] = [own[0], own[0], own[1][::-1]], 0  # edges on edges
    found = overlay.areas_of_units(unit, *flat(own), *flat(covers), layer, 2)
    whole = [overlay.areas_within([r for u, r in zip(unit, own) if u == k], [[r for a, r in zip(layer, covers) if a == j] for j in range(2)]) for k in range(50)]
    assert np.allclose(found, whole, atol=1e-11)
    none = overlay.areas_of_units(unit, *flat(own), *flat([]), np.empty(0, np.int64), 2)
    assert np.allclose(none[:, 0], found[:, 0], atol=1e-11) and not none[:, 1:].any()


def test_many_units_are_not_measured_one_by_one(spark, monkeypatch):
    square = [(0.001, 0.001), (0.002, 0.001), (0.002, 0.002), (0.001, 0.002)]
    units = spark.createDataFrame([(i, rings(square)) for i in range(2000)], f"k long, rings {RINGS}")
    own = overlay.areas_of_units
    calls = spark.sparkContext.accumulator(0)

    def counted(unit, *rest):
        calls.add(1)
        return own(unit, *rest)

    monkeypatch.setattr(overlay, "areas_of_units", counted)
    found = overlay.overlay_areas(units, "k", [units.limit(1)], 0.05).collect()
    assert len(found) == 2000 and {round(r["under_0"], 12) for r in found} == {1e-06}
    assert calls.value == 1  # one cell, one task
