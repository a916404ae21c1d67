"""Analytics over long pixel tables: masks, indices, composites, zonal statistics, terrain and change."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelytics import fixed_values as fv
from parcelytics.functions import numeric
from parcelytics.operators.aggregates import correlation
from parcelytics.plans.focal import focal_medians
from parcelytics.plans.scale import exact_quantiles, keep_first, maybe_broadcast, stack_rows


def qa_clear(qa: Column, thermal: Column, bits: Sequence[int] = fv.QA_MASK_BITS) -> Column:
    """No masked bit set, not fill (0), thermal present."""
    mask = sum(1 << b for b in bits)
    return (qa.bitwiseAND(F.lit(mask)) == 0) & (qa != 0) & (thermal > 0)


def qa_water(qa: Column) -> Column:
    return (qa.bitwiseAND(F.lit(1 << fv.QA_WATER_BIT)) != 0).cast("int")


def reflectance(digital: Column, gain: float = fv.REFLECTANCE_SCALE[0], offset: float = fv.REFLECTANCE_SCALE[1]) -> Column:
    return digital * gain + offset


def surface_celsius(digital: Column) -> Column:
    return digital * fv.THERMAL_SCALE[0] + fv.THERMAL_SCALE[1] - fv.KELVIN


def band_index(a: Column, b: Column) -> Column:
    """(a - b) / (a + b), NULL where the sum is zero."""
    return (a - b) / F.nullif(a + b, F.lit(0.0))


def scene_values(pixels: DataFrame) -> DataFrame:
    """Per scene and pixel: ndvi, ndbi, lst and water flag for clear observations, NULL otherwise."""
    clear = qa_clear(F.col("qa"), F.col("thermal"))
    red, nir, swir = (reflectance(F.col(c)) for c in ("red", "nir", "swir"))
    ndvi, ndbi = band_index(nir, red), band_index(swir, nir)
    ok = clear & ndvi.isNotNull() & ndbi.isNotNull()
    return pixels.select("scene", "x", "y", F.when(ok, ndvi).alias("ndvi"), F.when(ok, ndbi).alias("ndbi"),
                         F.when(ok, surface_celsius(F.col("thermal"))).alias("lst"), F.when(ok, qa_water(F.col("qa"))).alias("water"))


def temporal_median(values: DataFrame, cell: Sequence[str], bands: Sequence[str]) -> DataFrame:
    """Median composite per pixel and the number of clear observations; NULL observations are skipped."""
    # a pixel has as many observations as there are scenes, so one aggregate holds them whatever the area
    median = lambda b: F.percentile(F.nanvl(F.col(b).cast("double"), F.lit(None).cast("double")), F.lit(0.5)).alias(b)
    return values.groupBy(*cell).agg(F.count(bands[0]).alias("n_clear"), *[median(b) for b in bands])


def zone_pixels(pixels: DataFrame, zones: DataFrame, zone: str, radius: float) -> DataFrame:
    """Pixels whose centre lies within `radius` of a zone centre (zones: zone, cx, cy in pixel units).

    A pixel may serve several zones. Joined on square cells of the radius; hand in per-pixel sums, not raw scenes.
    """
    cell = lambda c, step=0: (F.floor(c / radius) + step).cast("long")
    around = F.explode(F.flatten(F.array(*[F.array(*[F.struct(cell(F.col("cx"), i).alias("i"), cell(F.col("cy"), j).alias("j"))
                                                     for j in (-1, 0, 1)]) for i in (-1, 0, 1)]))).alias("__cell")
    centres = zones.select(zone, "cx", "cy", around)
    located = pixels.withColumn("__cell", F.struct(cell(F.col("x")).alias("i"), cell(F.col("y")).alias("j")))
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    return located.join(maybe_broadcast(centres), "__cell").filter(dx * dx + dy * dy <= radius * radius).drop("__cell")


def zonal_mean(pixels: DataFrame, zones: DataFrame, zone: str, radius: float, value: str) -> DataFrame:
    """Mean of the value per zone ignoring NULL, from per-pixel sums, for every zone (NULL when it has no value)."""
    cells = pixels.groupBy("x", "y").agg(F.sum(value).alias("__s"), F.count(value).alias("__c"))
    sums = zone_pixels(cells, zones, zone, radius).groupBy(zone).agg(F.sum("__s").alias("s"), F.sum("__c").alias("n"))
    return zones.select(zone).join(sums, zone, "left").select(zone, F.coalesce("n", F.lit(0)).alias("n"), (F.col("s") / F.nullif("n", F.lit(0))).alias(f"mean_{value}"))


def zonal_class_share(pixels: DataFrame, zones: DataFrame, zone: str, radius: float, cls: str, wanted, no_data) -> DataFrame:
    """Share of one class among the pixels of a zone, no-data left out."""
    cells = pixels.filter(F.col(cls) != no_data).groupBy("x", "y").agg(F.count("*").alias("n"), F.count_if(F.col(cls) == wanted).alias("k"))
    sums = zone_pixels(cells, zones, zone, radius).groupBy(zone).agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    return sums.select(zone, "n", (F.col("k") / F.col("n")).alias("share"))


def masked_zonal_mean(pixels: DataFrame, zones: DataFrame, zone: str, radius: float, value: str, keep: Column) -> DataFrame:
    """Masked pixels leave the denominator; the masked percentage is reported."""
    cells = pixels.withColumn("__k", F.coalesce(keep, F.lit(False))).groupBy("x", "y").agg(
        F.count("*").alias("n"), F.count_if("__k").alias("k"), F.sum(F.when(F.col("__k"), F.col(value))).alias("s"))
    sums = zone_pixels(cells, zones, zone, radius).groupBy(zone).agg(*[F.sum(c).alias(c) for c in ("n", "k", "s")])
    return sums.select(zone, (F.col("s") / F.nullif("k", F.lit(0))).alias(f"mean_{value}"), (100 * (F.col("n") - F.col("k")) / F.col("n")).alias("masked_pct"))


def slope_from_grid(grid: DataFrame, value: str, dx: float, dy: float) -> DataFrame:
    """Slope in degrees by central differences, one-sided at the edges of each row and column.

    The windows run along single grid rows and columns, so a task holds one line of the raster.
    """
    def gradient(along: str, across: str, step: float) -> Column:
        line = Window.partitionBy(across).orderBy(along)
        before, after = F.lag(value).over(line), F.lead(value).over(line)
        return F.coalesce((after - before) / (2 * step), (after - F.col(value)) / step, (F.col(value) - before) / step, F.lit(0.0))

    out = grid.withColumn("__gx", gradient("x", "y", dx)).withColumn("__gy", gradient("y", "x", dy))
    return out.withColumn("slope_deg", F.degrees(F.atan(F.hypot("__gx", "__gy")))).drop("__gx", "__gy")


def window_classes(grid: DataFrame, points: DataFrame, point: str, cls: str, half: int) -> DataFrame:
    """Class at each point, and the modal (smallest on ties) and largest class in the square window around it."""
    counts = grid.groupBy("x", "y", cls).agg(F.count("*").alias("__n"))
    offsets = F.sequence(F.lit(-half), F.lit(half))
    spread = points.select(point, "px", "py", F.explode(offsets).alias("i")).select(
        point, "px", "py", (F.col("px") + F.col("i")).alias("x"), F.explode(offsets).alias("j")).select(
        point, "px", "py", "x", (F.col("py") + F.col("j")).alias("y"))
    near = spread.join(counts, ["x", "y"]).groupBy(point, cls).agg(
        F.sum("__n").alias("n"), F.sum(F.when((F.col("x") == F.col("px")) & (F.col("y") == F.col("py")), F.col("__n")).otherwise(0)).alias("here"))
    pick = lambda n: F.max(F.when(F.col(n) > 0, F.struct(F.col(n), (-F.col(cls)).alias("neg"))))
    out = near.groupBy(point).agg(F.sum("n").alias("window_pixels"), F.max(cls).alias("window_max"), pick("n").alias("m"), pick("here").alias("h"))
    return out.select(point, (-F.col("h.neg")).alias("point_class"), (-F.col("m.neg")).alias("window_mode"), "window_max", "window_pixels")


def constant_verdict(sampled: DataFrame, column: str) -> DataFrame:
    """Is a sampled class too constant to be a feature?"""
    n = F.count_distinct(column)
    return sampled.agg(n.alias("distinct")).withColumn(
        "verdict", F.when(F.col("distinct") <= 2, "near constant").when(F.col("distinct") <= 3, "low variance").otherwise("varies"))


def change_detect(values: DataFrame, cell: Sequence[str], value: str, base: Column, during: Column, drop: float = -3.0, level: float = -15.0,
                  exclude: DataFrame | None = None) -> DataFrame:
    """Per pixel: median before and during, and flag = drop below `drop` and level below `level`.

    Pixels in `exclude` (permanent water, high ground) are left out; a pixel needs both composites.
    """
    before = exact_quantiles(values.filter(base), cell, value, {"before": 0.5})
    after = exact_quantiles(values.filter(during), cell, value, {"during": 0.5})
    both = before.join(after, list(cell)).filter("before IS NOT NULL AND during IS NOT NULL")
    if exclude is not None:
        both = both.join(exclude.select(*cell), list(cell), "left_anti")
    return both.withColumn("flag", ((F.col("during") - F.col("before") < drop) & (F.col("during") < level)).cast("int"))


def focal_median(grid: DataFrame, value: str, radius: float) -> DataFrame:
    """`grid` with the median of the values within `radius` cells (a disc, its border included) of each cell (integer x, y).

    Missing values and cells that don't exist aren't counted; a cell without any value around gets NULL. Repeated cells count as
    often as they occur.
    """
    return grid.join(focal_medians(grid, value, radius, f"focal_{value}"), ["x", "y"], "left")


def choose_acquisition(events: DataFrame, passes: DataFrame) -> DataFrame:
    """Per event the satellite pass to use. `events`: event, base_from, base_to, flood_from, flood_to, peak (dates, ends
    exclusive); `passes`: orbit, acquired.

    An orbit qualifies with images in both windows; its best lag is the smallest on or after the peak, else the latest
    before. Orbits with an image on or after the peak come first, then the smallest |lag|.
    """
    acquired = passes.groupBy("orbit", "acquired").agg(F.count("*").alias("scenes"))
    inside = lambda a, b: (F.col("acquired") >= F.col(a)) & (F.col("acquired") < F.col(b))
    days = F.datediff("flood_to", "base_from")
    keyed = events.withColumn("acquired", F.explode(F.transform(F.sequence(F.lit(0), days - 1), lambda i: F.date_add("base_from", i))))
    joined = keyed.join(acquired, "acquired").withColumn("lag", F.datediff("acquired", "peak"))
    base, flood = inside("base_from", "base_to"), inside("flood_from", "flood_to")
    per = joined.groupBy("event", "orbit").agg(
        F.sum(F.when(base, F.col("scenes")).otherwise(0)).alias("n_base"), F.sum(F.when(flood, F.col("scenes")).otherwise(0)).alias("n_flood"),
        F.min(F.when(flood & (F.col("lag") >= 0), F.col("lag"))).alias("after"), F.max(F.when(flood, F.col("lag"))).alias("latest"))
    ranked = per.filter("n_base > 0 AND n_flood > 0").withColumn("best_lag", F.coalesce("after", "latest")).withColumn("late", F.col("after").isNull())
    best = keep_first(ranked.select("event", "orbit", "n_base", "n_flood", "best_lag", "late"), ["event"], [F.col("late"), F.abs("best_lag"), F.col("orbit")])
    return events.select("event").join(best, "event", "left").select(
        "event", "orbit", "n_base", "n_flood", "best_lag", F.col("orbit").isNull().alias("skipped"))


def event_mean(df: DataFrame, events: Sequence[str], name: str) -> DataFrame:
    """Mean over the event columns that are present, and whether every event is above 0 and above 1 %."""
    cols = [F.col(e) for e in events]
    every = lambda limit: F.forall(F.array(*cols), lambda v: F.coalesce(v > limit, F.lit(False)))
    return df.withColumn(name, numeric.mean_skip_null(cols)).withColumn("all_positive", every(0)).withColumn("all_above_1pct", every(0.01))


def event_pairs(df: DataFrame, events: Sequence[str]) -> DataFrame:
    pairs = [(a, b) for i, a in enumerate(events) for b in events[i + 1:]]
    stats = df.agg(*[correlation(F.col(a), F.col(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return stack_rows(stats, [(F.lit(a), F.lit(b), F.col(f"r{i}")) for i, (a, b) in enumerate(pairs)], ["a", "b", "r"])


def tag_category(tags: Column, rules: Sequence[tuple[str, str, Sequence[str]]] = fv.TAG_CATEGORIES) -> Column:
    """First rule (category, tag, accepted values) that the tag map satisfies."""
    out = F.lit(None).cast("string")
    for category, tag, accepted in reversed(list(rules)):
        out = F.when(F.try_element_at(tags, F.lit(tag)).isin(list(accepted)), F.lit(category)).otherwise(out)
    return out
