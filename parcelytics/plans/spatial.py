"""Spatial joins as equi-joins on grid cells.

A disc is covered by the cells its bounding box touches; a target lies in exactly one cell, so a pair appears once.
Cell width follows the latitude band, which keeps cells roughly square. Equal coordinates are reduced to one row
before any join, so copies of a point never multiply.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelytics import fixed_values as fv
from parcelytics.functions import geo
from parcelytics.plans.scale import maybe_broadcast, null_safe_join
from parcelytics.session import freeze


#: Different coordinates in a cell up to which a point on its border is compared with each, and levels of a pyramid.
CROWDED, DEEPEST = 512, 20


def _band_width(band: Column, step: float) -> Column:
    """Longitude width of the cells in a latitude band."""
    edge = F.greatest(F.abs(band * step), F.abs((band + 1) * step))
    return step / F.cos(F.radians(F.least(edge, F.lit(89.0))))


def target_cell(lat: Column, lon: Column, step: float) -> Column:
    band = F.floor(lat / step)
    return F.struct(band.alias("band"), F.floor(lon / _band_width(band, step)).alias("col"))


def disc_cells(lat: Column, lon: Column, radius_km: float, step: float, sphere_km: float) -> Column:
    """All cells a disc can touch, also beyond the date line; a disc over a pole touches its bands all around."""
    reach = math.degrees(radius_km / sphere_km) * (1 + 1e-9) + 1e-9
    sine = math.sin(math.radians(reach))
    ratio = F.lit(sine) / F.cos(F.radians(lat))
    lon_reach = F.when((ratio >= 1) | (F.abs(lat) + reach >= 90), F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) + 1e-9)
    bands = F.sequence(F.floor((lat - reach) / step), F.floor((lat + reach) / step))

    def columns(band: Column) -> Column:
        width = _band_width(band, step)
        none = F.array().cast("array<bigint>")
        around = lambda at: F.sequence(F.floor((at - lon_reach) / width), F.floor((at + lon_reach) / width))
        found = F.concat(
            around(lon), F.when(lon + lon_reach > 180, around(lon - 360)).otherwise(none), F.when(lon - lon_reach < -180, around(lon + 360)).otherwise(none)
        )
        return F.transform(F.array_distinct(found), lambda c: F.struct(band.alias("band"), c.alias("col")))

    return F.flatten(F.transform(bands, columns))


def pairs_within(points: DataFrame, targets: DataFrame, radius_km: float, by: Sequence[str] = (),
                 sphere_km: float = fv.FEATURE_RADIUS_KM) -> DataFrame:
    """Pairs at most `radius_km` apart (inclusive) with their distance in `km`.

    `points` has lat, lon; `targets` has t_lat, t_lon; `by` columns must agree.
    """
    step = math.degrees(radius_km / sphere_km)
    left = points.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).withColumn(
        "__cell", F.explode(disc_cells(F.col("lat"), F.col("lon"), radius_km, step, sphere_km)))
    right = targets.filter(F.col("t_lat").isNotNull() & F.col("t_lon").isNotNull()).withColumn(
        "__cell", target_cell(F.col("t_lat"), F.col("t_lon"), step))
    km = geo.haversine(F.col("lat"), F.col("lon"), F.col("t_lat"), F.col("t_lon"), sphere_km)
    return left.join(maybe_broadcast(right), ["__cell", *by]).drop("__cell").withColumn("km", km).filter(F.col("km") <= radius_km)


def distinct_targets(targets: DataFrame, lat: str, lon: str, by: Sequence[str] = (), payload: Sequence[str] = ()) -> DataFrame:
    """One row per distinct coordinate: how many targets share it, and the smallest payload."""
    aggs = [F.count("*").alias("__w")] + ([F.min(F.struct(*payload)).alias("__payload")] if payload else [])
    return targets.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).groupBy(
        *by, F.col(lat).alias("t_lat"), F.col(lon).alias("t_lon")).agg(*aggs)


def cell_at(lat: Column, lon: Column, step: float, level: int) -> Column:
    """The cell of a pyramid over `target_cell`: every level cuts both sides in four, so cells of a level lie in cells of the one above."""
    width = _band_width(F.floor(lat / step), step)
    return F.struct(F.floor(lat / step * 4.0**level).alias("band"), F.floor(lon / width * 4.0**level).alias("col"))


def cell_distance(lat: Column, lon: Column, cell: Column, step: float, level: int, sphere_km: float) -> tuple[Column, Column]:
    """(distance to the middle of a cell, reach of the cell around its middle): along the parallel, then along the meridian."""
    scale = 4.0**level
    width = _band_width(F.floor(cell["band"] / scale), step) / scale
    mid_lat, mid_lon = (cell["band"] + 0.5) * (step / scale), (cell["col"] + 0.5) * width
    reach = (step / scale / 2 + F.abs(F.cos(F.radians(mid_lat))) * width / 2) * (math.pi / 180 * sphere_km)
    return geo.haversine(lat, lon, mid_lat, mid_lon, sphere_km), reach * (1 + 1e-9) + 1e-9


def _is_crowded(spots: DataFrame, by: Sequence[str], step: float) -> bool:
    """Whether any cell holds so many different coordinates that comparing with each would be dear."""
    cells = spots.groupBy(*by, target_cell(F.col("t_lat"), F.col("t_lon"), step).alias("__c")).agg(F.count("*").alias("n"))
    return (cells.agg(F.max("n")).first()[0] or 0) > CROWDED


def pyramid(spots: DataFrame, by: Sequence[str], step: float) -> list[DataFrame]:
    """Counts per cell (by, cell, n coordinates, w targets): all cells first, then, level by level, the cells within crowded ones."""
    levels = []
    while True:
        level = len(levels)
        inside = spots.withColumn("cell", cell_at(F.col("t_lat"), F.col("t_lon"), step, level))
        if levels:
            above = inside.withColumn("__above", cell_at(F.col("t_lat"), F.col("t_lon"), step, level - 1))
            crowded = levels[-1].filter(F.col("n") > CROWDED).select(*by, F.col("cell").alias("__above"))
            inside = above.join(crowded, [*by, "__above"], "left_semi")
        levels.append(freeze(inside.groupBy(*by, "cell").agg(F.count("*").alias("n"), F.sum("__w").alias("w"))))
        if level == DEEPEST or levels[-1].filter(F.col("n") > CROWDED).isEmpty():
            return levels


def _children(open_cells: DataFrame, below: DataFrame, by: Sequence[str]) -> DataFrame:
    """The cells of the next level that lie in the cells of `open_cells` (lat, lon, by, cell)."""
    up = lambda c: F.floor(F.col(f"cell.{c}") / 4).alias(c)
    under = below.withColumn("__above", F.struct(up("band"), up("col")))
    return open_cells.select("lat", "lon", *by, F.col("cell").alias("__above")).join(under, [*by, "__above"]).drop("__above")


def _discs(points: DataFrame, radius_km: float, sphere_km: float, step: float) -> DataFrame:
    """Distinct points with every cell that their disc can touch."""
    coords = points.filter("lat IS NOT NULL AND lon IS NOT NULL")
    return coords.withColumn("cell", F.explode(disc_cells(F.col("lat"), F.col("lon"), radius_km, step, sphere_km)))


def count_within(points: DataFrame, targets: DataFrame, radius_km: float, by: Sequence[str] = (),
                 radius_of: dict[str, float] | None = None, sphere_km: float = fv.FEATURE_RADIUS_KM) -> DataFrame:
    """Targets within the radius per distinct point (and `by` group): lat, lon, *by, n; groups with none are absent.

    `radius_of` overrides the radius per value of the single `by` column. Cells that lie within the disc add their count; where a cell
    on the border holds many targets, the cells in it are looked at instead, so a point costs as many rows as its circle cuts cells.
    """
    coords = points.select("lat", "lon").distinct()
    reach = max([radius_km, *(radius_of or {}).values()])
    spots = distinct_targets(targets, "t_lat", "t_lon", by)
    step = math.degrees(reach / sphere_km)
    limit = F.lit(float(radius_km))
    for value, special in (radius_of or {}).items():
        limit = F.when(F.col(by[0]) == value, F.lit(float(special))).otherwise(limit)
    if not _is_crowded(spots, by, step):
        single = spots.withColumn("cell", target_cell(F.col("t_lat"), F.col("t_lon"), step))
        km = geo.haversine(F.col("lat"), F.col("lon"), F.col("t_lat"), F.col("t_lon"), sphere_km)
        met = _discs(coords, reach, sphere_km, step).join(maybe_broadcast(single), "cell").filter(km <= limit)
        return met.groupBy("lat", "lon", *by).agg(F.sum("__w").alias("n"))
    spots = freeze(spots)
    levels = pyramid(spots, by, step)
    reached = _discs(coords, reach, sphere_km, step).join(maybe_broadcast(levels[0]), "cell")
    parts = []
    for level, below in enumerate([*levels[1:], None]):
        middle, around = cell_distance(F.col("lat"), F.col("lon"), F.col("cell"), step, level, sphere_km)
        near = reached.withColumn("__m", middle).withColumn("__a", around).filter(F.col("__m") - F.col("__a") <= limit)
        near = near.withColumn("__whole", F.col("__m") + F.col("__a") <= limit).select("lat", "lon", *by, "cell", "n", "w", "__whole")
        near = freeze(near) if below is not None else near
        parts.append(near.filter("__whole").select("lat", "lon", *by, "w"))
        cut = near.filter("NOT __whole")
        few = cut if below is None else cut.filter(F.col("n") <= CROWDED)
        inside = spots.withColumn("cell", cell_at(F.col("t_lat"), F.col("t_lon"), step, level))
        km = geo.haversine(F.col("lat"), F.col("lon"), F.col("t_lat"), F.col("t_lon"), sphere_km)
        compared = few.select("lat", "lon", *by, "cell").join(maybe_broadcast(inside), [*by, "cell"]).filter(km <= limit)
        parts.append(compared.select("lat", "lon", *by, F.col("__w").alias("w")))
        if below is not None:
            reached = _children(cut.filter(F.col("n") > CROWDED), below, by)
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("lat", "lon", *by).agg(F.sum("w").alias("n"))


def closest_within(points: DataFrame, spots: DataFrame, radius_km: float, by: Sequence[str], payload: bool, sphere_km: float) -> DataFrame:
    """lat, lon, by, km, [__payload] of the nearest spot within the radius of each point; points without one are absent.

    A cell that holds a spot bounds the distance from above; cells that lie farther than the best bound of a point are dropped, crowded
    ones that remain are replaced by the cells in them. So a lonely point next to a cluster meets few of its spots.
    """
    step = math.degrees(radius_km / sphere_km)
    keys = ["lat", "lon", *by]
    best = lambda pairs: pairs.groupBy(*keys).agg(F.min(F.struct("km", *(["__payload"] if payload else []))).alias("b"))
    levels = pyramid(spots, by, step)
    reached = _discs(points, radius_km, sphere_km, step).join(maybe_broadcast(levels[0]), ["cell", *by])
    bound, pairs = None, None
    for level, below in enumerate([*levels[1:], None]):
        middle, around = cell_distance(F.col("lat"), F.col("lon"), F.col("cell"), step, level, sphere_km)
        near = reached.withColumn("__m", middle).withColumn("__a", around).filter(F.col("__m") - F.col("__a") <= radius_km)
        near = freeze(near.select(*keys, "cell", "n", "__m", "__a"))
        new = near.groupBy(*keys).agg(F.min(F.col("__m") + F.col("__a")).alias("__u"))
        bound = freeze((new if bound is None else bound.unionByName(new)).groupBy(*keys).agg(F.min("__u").alias("__u")))
        near = near.join(bound, keys).filter(F.col("__m") - F.col("__a") <= F.col("__u")).select(*keys, "cell", "n")
        few = near if below is None else near.filter(F.col("n") <= CROWDED)
        inside = spots.withColumn("cell", cell_at(F.col("t_lat"), F.col("t_lon"), step, level))
        km = geo.haversine(F.col("lat"), F.col("lon"), F.col("t_lat"), F.col("t_lon"), sphere_km)
        met = few.select(*keys, "cell").join(maybe_broadcast(inside), [*by, "cell"]).withColumn("km", km).filter(F.col("km") <= radius_km)
        met = met.select(*keys, "km", *(["__payload"] if payload else []))
        pairs = met if pairs is None else pairs.unionByName(met)
        if below is not None:
            reached = _children(near.filter(F.col("n") > CROWDED), below, by)
    return best(pairs)


def nearest(points: DataFrame, targets: DataFrame, by: str | None = None, values: Sequence[str] = (), payload: Sequence[str] = (),
            sphere_km: float = fv.FEATURE_RADIUS_KM) -> DataFrame:
    """Nearest target per distinct point (and `by` value): lat, lon, [by], km, payload columns.

    Searches discs of growing radius; a point leaves the search as soon as its disc holds a target, because every target in the
    disc was then compared. Without `values` the points have their own value of `by`. Once a cell of that size holds many targets, the rest descends a pyramid of cells. Rounds stop when nothing is pending or the disc spans the data. A point
    without any target (empty category) is absent from the result.
    """
    keys = ["lat", "lon"] + ([by] if by else [])
    spots = freeze(distinct_targets(targets, "t_lat", "t_lon", [by] if by else [], payload))
    coords = points.select("lat", "lon").filter("lat IS NOT NULL AND lon IS NOT NULL").distinct()
    extent = spots.select("t_lat", "t_lon").distinct().unionByName(
        coords.select(F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon")))
    frame = extent.agg(F.min("t_lat"), F.max("t_lat"), F.min("t_lon"), F.max("t_lon")).first()
    count = spots.groupBy(*([by] if by else [])).agg(F.count("*").alias("n")).agg(F.min("n"), F.max("n")).first()
    empty = coords.limit(0)
    if frame[0] is None or count[0] is None:
        out = empty.withColumn("km", F.lit(None).cast("double"))
        return out.withColumn(by, F.lit(None).cast("string")) if by else out
    degree = math.pi * sphere_km / 180
    height, width = (frame[1] - frame[0]) * degree, (frame[3] - frame[2]) * degree
    diameter = math.hypot(height, width) * 1.05 + 0.001
    radius = min(max(0.8 * math.sqrt(max(height * width, 1e-6) / count[0]), 0.05), diameter)
    pending = coords
    if by:
        own = not values and by in points.columns
        pending = points.select(*keys).filter(f"lat IS NOT NULL AND lon IS NOT NULL AND `{by}` IS NOT NULL").distinct() if own else coords.withColumn(
            by, F.explode(F.array(*[F.lit(v) for v in values])))
        present = spots.select(by).distinct()
        pending = pending.join(maybe_broadcast(present), by, "left_semi").select(*keys)
    found = None
    while True:
        crowded = _is_crowded(spots, [by] if by else [], math.degrees(radius / sphere_km))
        if crowded:  # the rest at once: far and dense cells cost little there
            radius = diameter
            best = closest_within(pending, spots, radius, [by] if by else [], bool(payload), sphere_km)
        else:
            pairs = pairs_within(pending, spots, radius, [by] if by else [], sphere_km)
            best = pairs.groupBy(*keys).agg(F.min(F.struct("km", *(["__payload"] if payload else []))).alias("b"))
        best = freeze(best.select(*keys, "b.km", *[F.col(f"b.__payload.{c}").alias(c) for c in payload]))
        found = best if found is None else found.unionByName(best)
        if radius >= diameter:
            return found
        pending = freeze(pending.join(best.select(*keys), keys, "left_anti"))
        if pending.isEmpty():
            return found
        radius = min(radius * 3, diameter)


def polygon_candidates(points: DataFrame, polygons: DataFrame, cell_deg: float) -> DataFrame:
    """Distinct points joined with the polygons whose bounding box holds them (inclusive)."""
    box = F.col("bbox")
    cells = F.flatten(F.transform(
        F.sequence(F.floor(box["min_lat"] / cell_deg), F.floor(box["max_lat"] / cell_deg)),
        lambda a: F.transform(
            F.sequence(F.floor(box["min_lon"] / cell_deg), F.floor(box["max_lon"] / cell_deg)),
            lambda o: F.struct(a.alias("a"), o.alias("o"))),
    ))
    boxed = polygons.withColumn("bbox", geo.ring_bbox(F.col("rings"))).withColumn("__cell", F.explode(cells))
    coords = points.select("lat", "lon").filter("lat IS NOT NULL AND lon IS NOT NULL").distinct().withColumn(
        "__cell", F.struct(F.floor(F.col("lat") / cell_deg).alias("a"), F.floor(F.col("lon") / cell_deg).alias("o")))
    return coords.join(maybe_broadcast(boxed), "__cell").drop("__cell").filter(
        F.col("lon").between(F.col("bbox.min_lon"), F.col("bbox.max_lon")) & F.col("lat").between(F.col("bbox.min_lat"), F.col("bbox.max_lat")))


def point_in_polygon(points: DataFrame, polygons: DataFrame, order: str, carry: Sequence[str], cell_deg: float = 0.05) -> DataFrame:
    """First polygon (by `order`) holding each distinct point: lat, lon and the carried columns; misses are absent."""
    inside = polygon_candidates(points, polygons, cell_deg).filter(
        F.exists("rings", lambda ring: geo.point_in_ring(F.col("lon"), F.col("lat"), ring)))
    best = inside.groupBy("lat", "lon").agg(F.min(F.struct(order, *[c for c in carry if c != order])).alias("b"))
    return best.select("lat", "lon", *[F.col(f"b.{c}").alias(c) for c in carry])


def attach_by_coordinate(points: DataFrame, found: DataFrame) -> DataFrame:
    """Fan results per distinct coordinate out to all rows."""
    return null_safe_join(points, found, ["lat", "lon"], "left")
