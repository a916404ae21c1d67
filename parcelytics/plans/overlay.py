"""Exact area of polygons under other polygons: rings are cut at grid cells, cells are swept in vertical slabs.

Between two neighbouring ends or crossings of edges no edges cross, so every slab is a stack of trapezoids whose area is width
times middle height. Areas of cells add up, whatever their size. Rings are cut, and the units of a cell swept, many at once: a batch
lies in flat arrays (points of all rings one after the other, and the number of points of each), without a step per ring or unit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelytics.plans.scale import spread
from parcelytics.session import freeze

#: Edges in a cell beyond which it is cut in four, and how often at most.
EDGES, DEPTH = 160, 16
#: Pieces of units in a cell up to which one task measures them all.
CELL_PIECES = 4096
#: Points (times cells reached into) of the rings cut at once, and numbers in the largest array of a sweep; a ring beyond the first goes cell by cell.
POINTS, NUMBERS = 2**16, 2**18
#: Rings of a problem that are told apart by one bit each.
BITS = 62


def clip(ring: np.ndarray, axis: int, bound: float, above: bool) -> np.ndarray:
    """The part of a ring (points x 2) on one side of a line parallel to an axis; parts may hang together along the line."""
    if not len(ring):
        return ring
    following = np.roll(ring, -1, axis=0)
    here, there = (p[:, axis] >= bound if above else p[:, axis] <= bound for p in (ring, following))
    step = following[:, axis] - ring[:, axis]
    share = np.divide(bound - ring[:, axis], step, out=np.zeros(len(ring)), where=step != 0)
    crossing = ring + share[:, None] * (following - ring)
    crossing[:, axis] = bound
    return np.stack([ring, crossing], 1)[np.stack([here, here != there], 1)]


def between(ring: np.ndarray, axis: int, low: float, high: float) -> np.ndarray:
    return clip(clip(ring, axis, low, True), axis, high, False)


def cell_pieces(ring: np.ndarray, size: float) -> Iterator[tuple[int, int, np.ndarray]]:
    """(column, row, part of the ring) for every grid cell the ring reaches into, row by row."""
    if len(ring) < 3:
        return
    first, last = np.floor(ring.min(0) / size).astype(int), np.floor(ring.max(0) / size).astype(int)
    for row in range(first[1], last[1] + 1):
        strip = between(ring, 1, row * size, (row + 1) * size)
        if len(strip) < 3:
            continue
        for column in range(max(first[0], int(np.floor(strip[:, 0].min() / size))), min(last[0], int(np.floor(strip[:, 0].max() / size))) + 1):
            part = between(strip, 0, column * size, (column + 1) * size)
            if len(part) >= 3 and np.ptp(part[:, 0]) > 0 and np.ptp(part[:, 1]) > 0:
                yield column, row, part


def _edges(rings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(x1, y1, x2, y2 from left to right, without vertical ones; number of the ring)."""
    parts = [np.concatenate([r, np.roll(r, -1, axis=0)], 1) for r in rings]
    edges, ring = np.concatenate(parts), np.repeat(np.arange(len(rings)), [len(r) for r in rings])
    turned = np.where((edges[:, 0] > edges[:, 2])[:, None], edges[:, [2, 3, 0, 1]], edges)
    sloped = turned[:, 0] < turned[:, 2]
    return turned[sloped], ring[sloped]


def _crossings(edges: np.ndarray) -> np.ndarray:
    """x of the points in which two edges cross."""
    x1, y1, x2, y2 = edges.T
    slope = (y2 - y1) / (x2 - x1)
    rise = slope[:, None] - slope[None, :]
    height = y1 - slope * x1
    x = np.divide(height[None, :] - height[:, None], rise, out=np.full(rise.shape, np.nan), where=rise != 0)
    low, high = np.maximum(x1[:, None], x1[None, :]), np.minimum(x2[:, None], x2[None, :])
    return x[(x > low) & (x < high)]


def areas_within(unit: list[np.ndarray], layers: list[list[np.ndarray]], depth: int = 0) -> np.ndarray:
    """Area of the union of the `unit` rings, and of its part under the union of each layer's rings."""
    out = np.zeros(1 + len(layers))
    rings = [*unit, *(r for layer in layers for r in layer)]
    if not unit:
        return out
    if sum(map(len, rings)) > EDGES and depth < DEPTH:
        low, high = np.min([r.min(0) for r in unit], 0), np.max([r.max(0) for r in unit], 0)
        mid = (low + high) / 2
        for x in ((low[0], mid[0]), (mid[0], high[0])):
            for y in ((low[1], mid[1]), (mid[1], high[1])):
                cut = lambda group: [p for r in group if len(p := between(between(r, 0, *x), 1, *y)) >= 3]  # noqa: E731, B023
                out += areas_within(cut(unit), [cut(layer) for layer in layers], depth + 1)
        return out
    edges, ring = _edges(rings)
    if not len(edges):
        return out
    bounds = np.unique(np.concatenate([edges[:, 0], edges[:, 2], _crossings(edges)]))
    width, middle = np.diff(bounds), (bounds[1:] + bounds[:-1]) / 2
    member = np.repeat(np.arange(1 + len(layers)), [len(unit), *map(len, layers)])
    for at in range(0, len(width), 64):
        w, m = width[at : at + 64], middle[at : at + 64, None]
        active = (edges[:, 0] < m) & (edges[:, 2] > m)
        y = np.where(active, edges[:, 1] + (edges[:, 3] - edges[:, 1]) / (edges[:, 2] - edges[:, 0]) * (m - edges[:, 0]), np.inf)
        order = np.argsort(y, axis=1)
        y = np.take_along_axis(y, order, 1)
        height = np.where(np.isfinite(y[:, 1:]), y[:, 1:] - np.where(np.isfinite(y[:, :-1]), y[:, :-1], 0), 0) * w[:, None]
        inside = np.zeros((len(out), *y.shape), bool)
        for k in range(len(rings)):
            inside[member[k]] |= np.cumsum((ring[order] == k) & np.isfinite(y), axis=1) % 2 == 1
        for k in range(len(out)):
            out[k] += (height * (inside[0] & inside[k])[:, :-1]).sum()
    return out


def _begins(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _spans(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of every span, one after the other."""
    return np.repeat(begins - _begins(sizes), sizes) + np.arange(sizes.sum())


def _runs(costs: np.ndarray, most: int) -> Iterator[slice]:
    """Neighbouring items that together cost at most `most` (or one item)."""
    ends, at = np.cumsum(costs), 0
    while at < len(costs):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield slice(at, end)
        at = end


def _clip_all(points: np.ndarray, sizes: np.ndarray, axis: int, bounds: np.ndarray, above: bool) -> tuple[np.ndarray, np.ndarray]:
    """`clip` of many rings, each at its own bound."""
    ring, following = np.repeat(np.arange(len(sizes)), sizes), np.arange(1, len(points) + 1)
    following[np.cumsum(sizes)[sizes > 0] - 1] = _begins(sizes)[sizes > 0]
    bound, ahead = bounds[ring], points[following]
    here = points[:, axis] >= bound if above else points[:, axis] <= bound
    step = ahead[:, axis] - points[:, axis]
    share = np.divide(bound - points[:, axis], step, out=np.zeros(len(points)), where=step != 0)
    crossing = points + share[:, None] * (ahead - points)
    crossing[:, axis] = bound
    kept = np.stack([here, here != here[following]], 1)
    return np.stack([points, crossing], 1)[kept], np.bincount(ring, kept.sum(1), len(sizes)).astype(np.int64)


def _between_all(points: np.ndarray, sizes: np.ndarray, axis: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _clip_all(*_clip_all(points, sizes, axis, low, True), axis, high, False)


def _boxes(points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest coordinates of each ring; all have points."""
    if not len(sizes):
        return np.empty((0, 2)), np.empty((0, 2))
    return np.minimum.reduceat(points, _begins(sizes)), np.maximum.reduceat(points, _begins(sizes))


def _cut(points: np.ndarray, sizes: np.ndarray, size: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the ring, column, row, points, points of each piece) for batches of the `cell_pieces` of many rings."""
    number, begins = np.flatnonzero(sizes >= 3), _begins(sizes)
    low, high = _boxes(points[_spans(begins[number], sizes[number])], sizes[number])
    first, last = np.floor(low / size), np.floor(high / size)
    with np.errstate(invalid="ignore"):
        cost = sizes[number] * np.prod(last - first + 1, axis=1)
    batched = np.isfinite(cost) & (cost <= POINTS)
    for n in number[~batched]:
        for column, row, piece in cell_pieces(points[begins[n] : begins[n] + sizes[n]], size):
            yield np.array([n]), np.array([column]), np.array([row]), piece, np.array([len(piece)])
    number, first, last, cost = number[batched], first[batched].astype(np.int64), last[batched].astype(np.int64), cost[batched]
    for run in _runs(cost, POINTS):
        n, rows = number[run], last[run, 1] - first[run, 1] + 1
        strip, row = np.repeat(np.arange(len(n)), rows), _spans(first[run, 1], rows)
        of = n[strip]
        p, k = _between_all(points[_spans(begins[of], sizes[of])], sizes[of], 1, row * size, (row + 1) * size)
        full = k >= 3
        p, k, strip, row = p[np.repeat(full, k)], k[full], strip[full], row[full]
        left, right = (np.floor(b[:, 0] / size).astype(np.int64) for b in _boxes(p, k))
        left = np.maximum(first[run, 0][strip], left)
        columns = np.maximum(np.minimum(last[run, 0][strip], right) + 1 - left, 0)
        part, column = np.repeat(np.arange(len(k)), columns), _spans(left, columns)
        p, k = _between_all(p[_spans(_begins(k)[part], k[part])], k[part], 0, column * size, (column + 1) * size)
        full = k >= 3
        p, k, part, column = p[np.repeat(full, k)], k[full], part[full], column[full]
        lows, highs = _boxes(p, k)
        full = (highs > lows).all(1)
        yield n[strip[part[full]]], column[full], row[part[full]], p[np.repeat(full, k)], k[full]


def _sweep(edges: np.ndarray, ring: np.ndarray, member: np.ndarray, counts: np.ndarray, layers: int) -> np.ndarray:
    """`areas_within` of many problems without a cut: problems x (1 + layers). `counts` edges each, one problem after the other; `ring` numbers
    the rings of a problem, `member` is the layer (0: the unit) of an edge's ring.
    """
    out = np.zeros((len(counts), 1 + layers))
    widths = np.maximum(-(-counts // 4) * 4, 4)
    for wide in np.unique(widths[counts > 0]):
        same = np.flatnonzero((widths == wide) & (counts > 0))
        for run in _runs(np.full(len(same), wide * wide), NUMBERS):
            n = same[run]
            taken = _spans(_begins(counts)[n], counts[n])
            at = np.repeat(np.arange(len(n)) * wide, counts[n]) + _spans(np.zeros(len(n), np.int64), counts[n])
            flat = np.full((4, len(n) * wide), np.nan)
            flat[:, at] = edges[taken].T
            x1, y1, x2, y2 = flat.reshape(4, len(n), wide)
            bits, masks = np.zeros(len(n) * wide, np.int64), []
            bits[at] = np.int64(1) << ring[taken]
            for layer in range(1 + layers):
                own = np.zeros(len(n) * wide, np.int64)
                own[at] = np.where(member[taken] == layer, bits[at], 0)
                masks.append(np.bitwise_or.reduce(own.reshape(len(n), wide), axis=1))
            bits = bits.reshape(len(n), wide)
            slope = (y2 - y1) / (x2 - x1)
            height = y1 - slope * x1
            i, j = np.triu_indices(wide, 1)
            rise = slope[:, i] - slope[:, j]
            with np.errstate(invalid="ignore", divide="ignore"):
                x = (height[:, j] - height[:, i]) / rise
                x[~((rise != 0) & (x > np.maximum(x1[:, i], x1[:, j])) & (x < np.minimum(x2[:, i], x2[:, j])))] = np.nan
            bounds = np.sort(np.concatenate([x1, x2, x], 1), axis=1)  # missing ones last
            problem, slab = np.nonzero(bounds[:, 1:] > bounds[:, :-1])
            low, high = bounds[problem, slab], bounds[problem, slab + 1]
            for part in _runs(np.full(len(problem), wide), NUMBERS):
                of, w, m = problem[part], (high - low)[part], ((high + low) / 2)[part, None]
                active = (x1[of] < m) & (x2[of] > m)
                y = np.where(active, y1[of] + slope[of] * (m - x1[of]), np.inf)
                order = np.argsort(y, axis=1)
                y = np.take_along_axis(y, order, 1)
                within = np.bitwise_xor.accumulate(np.take_along_axis(np.where(active, bits[of], 0), order, 1), axis=1)[:, :-1]
                finite = np.isfinite(y)
                tall = np.where(finite[:, 1:], y[:, 1:] - np.where(finite[:, :-1], y[:, :-1], 0), 0) * w[:, None]
                inside = (within & masks[0][of, None]) != 0
                for layer in range(1 + layers):
                    area = np.where(inside & ((within & masks[layer][of, None]) != 0), tall, 0).sum(1)
                    out[n, layer] += np.bincount(of, area, len(n))
    return out


def areas_of_units(unit: np.ndarray, points: np.ndarray, sizes: np.ndarray, covers: np.ndarray, cover_sizes: np.ndarray, layer: np.ndarray, layers: int) -> np.ndarray:
    """units x (1 + layers): `areas_within` of each unit (its rings have the numbers `unit`, 0, 1, ...) and the covers whose boxes meet its own."""
    by_unit = np.argsort(unit, kind="stable")
    points, sizes, unit = points[_spans(_begins(sizes)[by_unit], sizes[by_unit])], sizes[by_unit], unit[by_unit]
    by_layer = np.argsort(layer, kind="stable")
    covers, cover_sizes, layer = covers[_spans(_begins(cover_sizes)[by_layer], cover_sizes[by_layer])], cover_sizes[by_layer], layer[by_layer]
    rings = np.bincount(unit)
    low, high = _boxes(points, sizes)
    low, high = np.minimum.reduceat(low, _begins(rings)), np.maximum.reduceat(high, _begins(rings))
    cover_low, cover_high = _boxes(covers, cover_sizes)
    pool, lengths = np.concatenate([points, covers]), np.concatenate([sizes, cover_sizes])
    begins, members = _begins(lengths), np.concatenate([np.zeros(len(sizes), np.int64), layer + 1])
    following = np.arange(1, len(pool) + 1)
    following[np.cumsum(lengths) - 1] = begins
    edges = np.concatenate([pool, pool[following]], 1)
    edges = np.where((edges[:, 0] > edges[:, 2])[:, None], edges[:, [2, 3, 0, 1]], edges)
    sloped = edges[:, 0] < edges[:, 2]
    edges, many = edges[sloped], np.add.reduceat(sloped, begins, dtype=np.int64)
    out = np.zeros((len(rings), 1 + layers))
    for some in _runs(rings + len(cover_sizes), NUMBERS):  # the boxes of some units against those of all covers
        near = (cover_low[None, :, 0] < high[some, None, 0]) & (cover_low[None, :, 1] < high[some, None, 1])
        near &= (cover_high[None, :, 0] > low[some, None, 0]) & (cover_high[None, :, 1] > low[some, None, 1])
        problem, cover = np.nonzero(near)
        own = _spans(_begins(rings)[some], rings[some])
        problem, source = np.concatenate([unit[own] - some.start, problem]), np.concatenate([own, len(sizes) + cover])
        order = np.argsort(problem, kind="stable")
        problem, source = problem[order], source[order]
        held = np.bincount(problem, minlength=some.stop - some.start)
        large = (np.bincount(problem, lengths[source], len(held)) > EDGES) | (held > BITS)
        for n in np.flatnonzero(large):
            found = [(members[r], pool[begins[r] : begins[r] + lengths[r]]) for r in source[_begins(held)[n] : _begins(held)[n] + held[n]]]
            group = lambda k: [ring for at, ring in found if at == k]  # noqa: E731, B023
            out[some.start + n] = areas_within(group(0), [group(1 + k) for k in range(layers)])
        swept = ~large
        number = _spans(np.zeros(len(held), np.int64), held)[swept[problem]]
        source, problem = source[swept[problem]], problem[swept[problem]]
        counts = np.bincount(problem, many[source], len(held)).astype(np.int64)
        for run in _runs(counts, NUMBERS // 4):
            within = slice(*np.searchsorted(problem, [run.start, run.stop]))
            s = source[within]
            taken = _spans(_begins(many)[s], many[s])
            out[some.start + run.start : some.start + run.stop] += _sweep(
                edges[taken], np.repeat(number[within], many[s]), np.repeat(members[s], many[s]), counts[run], layers)
    return out


def _arrays(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of arrays, and their numbers; missing arrays are empty."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False), sizes


def _rings(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Points and their numbers of a column of binary pieces."""
    pieces = column.to_pylist()
    return np.frombuffer(b"".join(pieces)).reshape(-1, 2), np.array([len(p) // 16 for p in pieces], np.int64)


def _pieces(df: DataFrame, columns: list[str], size: float) -> DataFrame:
    """(columns, cx, cy, piece): the parts of all `rings` (arrays of lon, lat) in the cells they reach into."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (lon, sizes), (lat, _) = _arrays(batch["lon"]), _arrays(batch["lat"])
            for ring, column, row, points, many in _cut(np.stack([lon, lat], 1), sizes, size):
                ends = np.concatenate([[0], np.cumsum(many * 16)]).astype(np.int32)
                piece = pa.Array.from_buffers(pa.binary(), len(many), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(points))])
                kept = [batch[c].take(pa.array(ring)) for c in columns]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(column, pa.int64()), pa.array(row, pa.int64()), piece], [*columns, "cx", "cy", "piece"])

    flat = df.select(*columns, F.explode("rings").alias("r")).select(*columns, *[F.col(f"r.{c}").cast("array<double>").alias(c) for c in ("lon", "lat")])
    flat = flat.filter(~F.exists("lon", lambda v: v.isNull() | F.isnan(v)) & ~F.exists("lat", lambda v: v.isNull() | F.isnan(v)))
    own = [flat.schema[c] for c in columns]
    return spread(flat).mapInArrow(cut, T.StructType([*own, *T._parse_datatype_string("cx long, cy long, piece binary")]))


def overlay_areas(units: DataFrame, key: str, layers: list[DataFrame], size: float) -> DataFrame:
    """key, area, under_0, under_1, ...: square units of each unit's rings, and of what lies under the union of each layer.

    A polygon is the union of its rings. Rings with missing coordinates are left out, as are units without area. Pieces meet by grid
    cell; equal pieces of a layer count once. The units of a full cell are dealt over several tasks, each with the layers' pieces there.
    """
    below = [f"under_{k}" for k in range(len(layers))]

    def measured(cell: tuple, own: pa.Table, other: pa.Table) -> pa.Table:
        units_ = own["unit"].combine_chunks().dictionary_encode()
        if not len(units_):
            return pa.table([pa.array([], units_.type.value_type), *[pa.array([], pa.float64())] * (1 + len(below))], ["unit", "area", *below])
        layer = np.array(other["layer"].to_pylist(), np.int64)
        found = areas_of_units(units_.indices.to_numpy().astype(np.int64), *_rings(own["piece"]), *_rings(other["piece"]), layer, len(below))
        return pa.table([units_.dictionary, *map(pa.array, found.T)], ["unit", "area", *below])

    pieces = freeze(_pieces(units.filter(F.col(key).isNotNull()).select(F.col(key).alias("unit"), "rings"), ["unit"], size))
    cells = freeze(pieces.groupBy("cx", "cy").agg(F.ceil(F.count("*") / CELL_PIECES).alias("parts")))
    parts = cells.agg(F.sum("parts")).first()[0] or 1
    cores = units.sparkSession.sparkContext.defaultParallelism
    tasks, place = min(parts, max(4 * cores, parts // 64)), ["cx", "cy", "part"]
    every = [_pieces(layer.select(F.lit(k).alias("layer"), "rings"), ["layer"], size) for k, layer in enumerate(layers)]
    stacked = every[0]
    for layer in every[1:]:
        stacked = stacked.unionByName(layer)
    numbers = T._parse_datatype_string(", ".join(f"{c} double" for c in ("area", *below)))
    dealt = pieces.join(cells, ["cx", "cy"]).withColumn("part", F.pmod(F.xxhash64("unit"), F.col("parts"))).select("unit", *place, "piece")
    there = stacked.distinct().join(cells, ["cx", "cy"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    grouped = [side.repartition(tasks, *place).groupBy(*place) for side in (dealt, there.select("layer", *place, "piece"))]
    found = grouped[0].cogroup(grouped[1]).applyInArrow(measured, T.StructType([pieces.schema["unit"], *numbers]))
    return found.groupBy(F.col("unit").alias(key)).agg(*[F.sum(c).alias(c) for c in ("area", *below)])
