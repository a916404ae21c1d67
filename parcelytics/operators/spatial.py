"""Distances, proximity features, location lookup, geocoder-hit selection and pin checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelytics import fixed_values as fv
from parcelytics.functions import geo, text
from parcelytics.plans.claims import claim_in_order
from parcelytics.plans.overlay import overlay_areas
from parcelytics.plans.scale import keep_first, null_safe_join, top_k_per_group
from parcelytics.plans.spatial import attach_by_coordinate, count_within, nearest, pairs_within, point_in_polygon


def nearest_km(points: DataFrame, targets: DataFrame, by: str | None = None, values: Sequence[str] = ()) -> DataFrame:
    """Every point row with its nearest target distance (per category when `by` is given, long form, NULL if none)."""
    found = nearest(points, targets, by, values)
    if not by:
        return attach_by_coordinate(points, found)
    spread = points.withColumn(by, F.explode(F.array(*[F.lit(v) for v in values])))
    return null_safe_join(spread, found, ["lat", "lon", by], "left")


def targets_within(points: DataFrame, targets: DataFrame, radius_km: float) -> DataFrame:
    """Every point row with the number of targets within the radius, zero when there are none."""
    return attach_by_coordinate(points, count_within(points, targets, radius_km)).na.fill(0, ["n"])


def proximity_features(units: DataFrame, unit: str, targets: DataFrame, category: str, values: Sequence[str],
                       radius_km: float, radius_of: dict[str, float] | None = None,
                       centre: tuple[float, float] | None = fv.CITY_CENTRE) -> DataFrame:
    """Wide table per unit: distance from the centre, min_dist_<category> and count_<category>.

    Computed once per distinct unit coordinate; join it to the facts on the unit afterwards.
    """
    counts = count_within(units, targets, radius_km, [category], radius_of)
    close = nearest(units, targets, category, values)
    per = close.select("lat", "lon", category, "km").join(counts, ["lat", "lon", category], "full_outer")
    wide = per.groupBy("lat", "lon").pivot(category, list(values)).agg(F.min("km").alias("km"), F.max("n").alias("n"))
    named = wide.select("lat", "lon", *[F.col(f"`{v}_km`").alias(f"min_dist_{v}") for v in values],
                        *[F.coalesce(F.col(f"`{v}_n`"), F.lit(0)).alias(f"count_{v}") for v in values])
    out = null_safe_join(units.select(unit, "lat", "lon"), named, ["lat", "lon"], "left").na.fill(0, [f"count_{v}" for v in values])
    if centre is not None:
        out = out.withColumn("distance_from_centre", geo.distance_to_point(F.col("lat"), F.col("lon"), centre))
    return out


def locate(points: DataFrame, polygons: DataFrame, order: str, cell_deg: float = 0.05) -> DataFrame:
    """Division lookup for points: a modelled polygon first, else an unmodelled one, always the nearest modelled centre.

    `polygons`: order column, address, modelled, c_lat, c_lon, rings. Adds division, gn_address, match
    ('polygon' or 'outside'), known, nearest_division, distance_km (0 inside a modelled polygon, else 2 decimals).
    """
    modelled, other = polygons.filter("modelled"), polygons.filter("NOT modelled")
    hit = point_in_polygon(points, modelled, order, [order, "address"], cell_deg).select("lat", "lon", F.col("address").alias("__m"))
    second = point_in_polygon(points, other, order, [order, "address"], cell_deg).select("lat", "lon", F.col("address").alias("__o"))
    centres = modelled.select(F.col("c_lat").alias("t_lat"), F.col("c_lon").alias("t_lon"), order, "address")
    close = nearest(points, centres, payload=[order, "address"], sphere_km=fv.SERVING_RADIUS_M / 1000).select(
        "lat", "lon", F.col("address").alias("__n"), F.col("km").alias("__km"))
    out = attach_by_coordinate(attach_by_coordinate(attach_by_coordinate(points, hit), second), close)
    inside = F.col("__m").isNotNull()
    return out.select(
        *points.columns, F.col("__m").alias("division"), F.coalesce("__m", "__o").alias("gn_address"),
        F.when(inside, "polygon").otherwise("outside").alias("match"), inside.alias("known"),
        F.when(~inside, F.col("__n")).alias("nearest_division"),
        F.when(inside, F.lit(0.0)).otherwise(F.bround("__km", 2)).alias("distance_km"),
    )


def vertices(polygons: DataFrame, key: str, thin: int = 1) -> DataFrame:
    """Ring vertices as targets (t_lat, t_lon); `thin` keeps every n-th vertex of a ring."""
    kept = F.flatten(F.transform("rings", lambda ring: F.filter(ring, lambda _p, i: i % thin == 0)))
    return polygons.select(key, F.explode(kept).alias("v")).select(key, F.col("v.lat").alias("t_lat"), F.col("v.lon").alias("t_lon"))


def nearest_vertex_km(points: DataFrame, polygons: DataFrame, key: str) -> DataFrame:
    """Distance to the nearest boundary vertex, with the owner of that vertex."""
    return attach_by_coordinate(points, nearest(points, vertices(polygons, key), payload=[key]))


def within_buffer_units(units: DataFrame, key: str, region: DataFrame, region_key: str, km: float, thin: int = 1) -> DataFrame:
    """Units with a vertex within `km` of a vertex of the region."""
    own = vertices(units, key, thin).select(key, F.col("t_lat").alias("lat"), F.col("t_lon").alias("lon"))
    spots = own.select("lat", "lon").distinct()
    near = pairs_within(spots, vertices(region, region_key, thin).select("t_lat", "t_lon").distinct(), km).select("lat", "lon").distinct()
    return units.join(own.join(near, ["lat", "lon"], "left_semi").select(key).distinct(), key, "left_semi")


def geocode_adjudicate(hits: DataFrame, unit: str, allowed: Sequence[str], limit_km: dict[str, float], default_limit: float = 2.0,
                       box: dict = fv.HIT_BOX) -> tuple[DataFrame, DataFrame]:
    """(chosen, rejected counts) from a table of geocoder hits.

    `hits`: unit, category, tier, class, lat, lon, anchor_lat, anchor_lon. A hit must be of an allowed class, inside
    the box and (except for the 'address' tier, number 1) within the category's radius of the unit's anchor. The
    first tier with a surviving hit wins, nearest first.
    """
    km = geo.haversine(F.col("anchor_lat"), F.col("anchor_lon"), F.col("lat"), F.col("lon"), fv.MATCH_RADIUS_KM)
    limit = F.lit(float(default_limit))
    for category, value in limit_km.items():
        limit = F.when(F.col("category") == category, F.lit(float(value))).otherwise(limit)
    reason = (
        F.when(~F.col("class").isin(list(allowed)), "class").when(~geo.in_box(F.col("lat"), F.col("lon"), box), "outside box")
        .when((F.col("tier") != 1) & (F.col("km") > limit), "too far")
    )
    judged = hits.withColumn("km", km).withColumn("reason", reason)
    order = [F.col("tier"), F.col("km"), F.col("lat"), F.col("lon")]
    chosen = keep_first(judged.filter("reason IS NULL").select(unit, "tier", "km", "lat", "lon", "class"), [unit], order)
    units = hits.select(unit).distinct().join(chosen, unit, "left").withColumn(
        "status", F.when(F.col("tier").isNull(), "failed").otherwise("ok"))
    rejected = judged.filter("reason IS NOT NULL").groupBy(unit, "reason").agg(F.count("*").alias("n"), F.min("km").alias("min_km"))
    return units, rejected


def earliest_neighbours(units: DataFrame, order: str, metres: float, sphere_km: float = fv.MATCH_RADIUS_KM) -> DataFrame:
    """Distinct-coordinate pairs within `metres`: lat, lon, t_lat, t_lon (each coordinate is its own neighbour)."""
    spots = units.select("lat", "lon").distinct()
    return pairs_within(spots, spots.select(F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon")), metres / 1000, sphere_km=sphere_km).drop("km")


def duplicate_pin_audit(units: DataFrame, order: str, name: str, metres: float = fv.DUPLICATE_PIN_M) -> DataFrame:
    """Each unit against the earliest other unit within `metres`: owner order and verdict shared / blocked / free.

    Only the two earliest units per coordinate travel through the join, so a pin shared by many stays one row.
    """
    first = units.groupBy(F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon")).agg(
        F.min(F.struct(F.col(order).alias("o"), F.col(name).alias("nm"))).alias("owner"))
    around = earliest_neighbours(units, order, metres).join(first, ["t_lat", "t_lon"]).groupBy("lat", "lon").agg(F.min("owner").alias("owner"))
    joined = null_safe_join(units, around, ["lat", "lon"], "left")
    earlier = F.col("owner.o") < F.col(order)
    overlap = F.arrays_overlap(text.distinctive_tokens(F.col(name)), text.distinctive_tokens(F.col("owner.nm")))
    return joined.select(
        *units.columns, F.when(earlier, F.col("owner.o")).alias("owner_order"),
        F.when(~earlier, "free").when(overlap, "shared").otherwise("blocked").alias("verdict"),
    )


def claim_pins(units: DataFrame, order: str, name: str, metres: float = fv.DUPLICATE_PIN_M) -> DataFrame:
    """Greedy claiming in order: a blocked unit does not claim its pin, so it cannot block a later one.

    Tiles of the map are walked in order by one task each, with what stands at their border; a chain of decisions costs a round
    for each tile it crosses (see `plans.claims`). Units without a coordinate are free.
    """
    named = units.select(F.col(order).alias("o"), F.col(name).alias("nm"), F.col("lat").cast("double"), F.col("lon").cast("double"))
    verdicts = claim_in_order(named, metres / 1000, fv.MATCH_RADIUS_KM)
    return units.join(verdicts.select(F.col("o").alias(order), "verdict"), order)


def anchor_collapse(anchors: DataFrame, lat: str, lon: str, label: str, digits: int = 4) -> DataFrame:
    """Coordinates (rounded half to even) that serve more than one label, with how many labels and rows."""
    return anchors.groupBy(F.bround(lat, digits).alias("lat"), F.bround(lon, digits).alias("lon")).agg(
        F.count_distinct(label).alias("n_labels"), F.count("*").alias("n"), F.min(label).alias("first_label")).filter("n_labels > 1")


def distance_check(df: DataFrame, km: Column, stated: Column, tolerance: float, min_ratio: float) -> DataFrame:
    """Symmetric check |km - stated| <= tolerance and one-sided check: not beyond stated + tolerance, not below a ratio."""
    return df.withColumn("km", km).withColumn("agrees", F.coalesce(F.abs(km - stated) <= tolerance, F.lit(True))).withColumn(
        "one_sided", F.when(km > stated + tolerance, "overshoot").when(km < stated * min_ratio, "too short").otherwise("ok"))


def landmark_vote(texts: DataFrame, keys: Sequence[str], body: str, regions: dict[str, dict[str, Sequence[str]]], share: float = 0.60) -> DataFrame:
    """Mentions per region for each key, the majority region (at least `share`) and the most named landmark.

    `regions`: region -> landmark -> spellings; counted as non-overlapping substrings of the lower-cased text.
    """
    low = F.lower(F.col(body))
    names = [(region, mark, spellings) for region, marks in regions.items() for mark, spellings in marks.items()]
    counted = texts.select(*keys, low.alias("__t")).select(
        *keys, *[sum((text.count_occurrences(F.col("__t"), s) for s in spellings), F.lit(0)).alias(f"c{i}")
                 for i, (_r, _m, spellings) in enumerate(names)])
    sums = counted.groupBy(*keys).agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(len(names))])
    total = {region: sum((F.col(f"c{i}") for i, n in enumerate(names) if n[0] == region), F.lit(0)) for region in regions}
    every = sum((F.col(f"c{i}") for i in range(len(names))), F.lit(0))
    winner = F.lit("no majority")
    for region, count in reversed(list(total.items())):
        winner = F.when(count / F.nullif(every, F.lit(0)) >= share, F.lit(region)).otherwise(winner)
    best = F.array_max(F.array(*[F.struct(F.col(f"c{i}").alias("n"), F.lit(-i).alias("o"), F.lit(n[1]).alias("m")) for i, n in enumerate(names)]))
    return sums.select(*keys, *[c.alias(f"mentions_{region}") for region, c in total.items()],
                       F.coalesce(winner, F.lit("no majority")).alias("majority"), F.when(every > 0, best["m"]).alias("top_landmark"))


def triangulate(candidates: DataFrame, lat: str, lon: str, claims: Sequence[tuple[float, float, float]]) -> DataFrame:
    """Mean absolute error between stated and real distances to known landmarks, per candidate."""
    errors = [F.abs(geo.haversine(F.col(lat), F.col(lon), F.lit(a), F.lit(o), fv.MATCH_RADIUS_KM) - km) for a, o, km in claims]
    return candidates.withColumn("mean_error_km", sum(errors, F.lit(0.0)) / len(claims))


def areal_share(units: DataFrame, key: str, coverage: DataFrame, extent: DataFrame, cell_deg: float = 0.05) -> DataFrame:
    """Covered and flooded share of each unit's whole area: key, covered, flooded_share.

    Both are exact areas of intersection with the union of the polygons, over the area of the unit; the flooded share is 0 where
    nothing is covered, and need not lie in the covered part. Shares are taken in the plane of degrees, in which a local
    projection only changes the scale. Units without area are left out. All three tables have `rings`.
    """
    found = overlay_areas(units, key, [coverage, extent], cell_deg)
    covered = F.col("under_0") / F.col("area")
    return found.filter("area > 0").select(
        key, covered.alias("covered"), F.when(covered > fv.LEAST_COVERED, F.col("under_1") / F.col("area")).otherwise(0.0).alias("flooded_share"))


def nearby(points: DataFrame, targets: DataFrame, category: str, label: Column, radius_m: float = fv.NEARBY_RADIUS_M,
           k: int = fv.NEARBY_PER_CATEGORY, tie: Sequence[str] = ()) -> DataFrame:
    """The k nearest targets per category around each distinct point, rounded metres, name fallback.

    Coordinates shared by many targets are cut to k per category before the join, because no more can be shown.
    """
    spots = top_k_per_group(targets.withColumn("label", label), [category, "t_lat", "t_lon"], [F.col(c) for c in tie], k, "__rn").drop("__rn")
    radius_km = radius_m / 1000
    pairs = pairs_within(points.select("lat", "lon").distinct(), spots, radius_km, sphere_km=fv.SERVING_RADIUS_M / 1000)
    ranked = pairs.withColumn("distance_m", F.bround(F.col("km") * 1000, 0).cast("long"))
    best = top_k_per_group(ranked, ["lat", "lon", category], [F.col("distance_m"), *[F.col(c) for c in tie]], k, "rank")
    return best.select("lat", "lon", category, "rank", "label", "distance_m", *tie)


