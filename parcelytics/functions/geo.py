"""Spherical geometry as native column expressions; points are (lat, lon) in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelytics import fixed_values as fv


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = fv.FEATURE_RADIUS_KM) -> Column:
    """Great-circle distance in the unit of `radius`."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    half_dp, half_dl = (p2 - p1) / 2, F.radians(lon2 - lon1) / 2
    h = F.sin(half_dp) * F.sin(half_dp) + F.cos(p1) * F.cos(p2) * F.sin(half_dl) * F.sin(half_dl)
    return 2 * radius * F.asin(F.sqrt(F.when(h > 1, F.lit(1.0)).otherwise(h)))


def distance_to_point(lat: Column, lon: Column, point: tuple[float, float] = fv.CITY_CENTRE,
                      radius: float = fv.FEATURE_RADIUS_KM) -> Column:
    return haversine(lat, lon, F.lit(point[0]), F.lit(point[1]), radius)


def in_box(lat: Column, lon: Column, box: dict) -> Column:
    return lat.between(*box["lat"]) & lon.between(*box["lon"])


def point_in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Edge-crossing parity over a ring of struct(lon, lat); points on an edge may fall either way."""
    size = F.size(ring)
    crossings = F.aggregate(
        F.sequence(F.lit(0), size - 1),
        F.lit(0),
        lambda acc, i: acc
        + F.when(
            (ring[i]["lat"] > lat) != (ring[(i + size - 1) % size]["lat"] > lat),
            (
                lon
                < (ring[(i + size - 1) % size]["lon"] - ring[i]["lon"])
                * (lat - ring[i]["lat"])
                / (ring[(i + size - 1) % size]["lat"] - ring[i]["lat"])
                + ring[i]["lon"]
            ).cast("int"),
        ).otherwise(F.lit(0)),
    )
    return crossings % 2 == 1


def spherical_ring_area(ring: Column, radius: float = fv.SERVING_RADIUS_M) -> Column:
    """Area on the sphere of an array of struct(lon, lat); fewer than three vertices give 0, rings are auto-closed."""
    nxt = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    wedges = F.zip_with(
        ring,
        nxt,
        lambda a, b: F.radians(b["lon"] - a["lon"]) * (2 + F.sin(F.radians(a["lat"])) + F.sin(F.radians(b["lat"]))),
    )
    total = F.aggregate(wedges, F.lit(0.0), lambda acc, w: acc + w)
    return F.when(F.size(ring) < 3, F.lit(0.0)).otherwise(F.abs(total * radius * radius / 2))


def m2_to_perches(area: Column) -> Column:
    return area / fv.PERCH_M2


def ring_centroid(ring: Column) -> Column:
    """Mean of the vertices as struct(lon, lat)."""
    n = F.size(ring)
    total = lambda field: F.aggregate(ring, F.lit(0.0), lambda acc, p: acc + p[field])
    return F.struct((total("lon") / n).alias("lon"), (total("lat") / n).alias("lat"))


def ring_bbox(rings: Column) -> Column:
    """Struct(min_lon, min_lat, max_lon, max_lat) over an array of rings."""
    lons = F.transform(F.flatten(rings), lambda p: p["lon"])
    lats = F.transform(F.flatten(rings), lambda p: p["lat"])
    return F.struct(
        F.array_min(lons).alias("min_lon"), F.array_min(lats).alias("min_lat"),
        F.array_max(lons).alias("max_lon"), F.array_max(lats).alias("max_lat"),
    )


def cache_bucket(col: Column, step: float = fv.CACHE_BUCKET) -> Column:
    """Bucket index, rounded half to even."""
    return F.bround(col / F.lit(step), 0).cast("long")
