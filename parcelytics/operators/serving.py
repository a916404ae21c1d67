"""Serving tables, batch scoring, flood records and assembled admin units."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelytics import fixed_values as fv
from parcelytics.functions import geo, numeric, text
from parcelytics.operators import aggregates, features as ft
from parcelytics.plans.scale import attach_scalar, maybe_broadcast, stack_rows, top_k_per_group
from parcelytics.session import freeze


@dataclass
class ServingTables:
    """encoding: division, target_enc; lookup: division, listing_count, feature medians; fallback: one row
    global_mean_log_price plus the medians of the lookup; order: feature names in model order."""

    encoding: DataFrame
    lookup: DataFrame
    fallback: DataFrame
    order: list[str]

    def write(self, path: str) -> None:
        for name in ("encoding", "lookup", "fallback"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        spark = self.lookup.sparkSession
        spark.createDataFrame(list(enumerate(self.order)), "position int, feature string").write.mode("overwrite").parquet(f"{path}/order")

    @classmethod
    def read(cls, spark, path: str) -> "ServingTables":
        order = [r["feature"] for r in spark.read.parquet(f"{path}/order").orderBy("position").collect()]
        return cls(*[spark.read.parquet(f"{path}/{name}") for name in ("encoding", "lookup", "fallback")], order)


def build_serving_tables(train: DataFrame, division: str, target: str, columns: Sequence[str], order: Sequence[str]) -> ServingTables:
    encoding = ft.target_encoding(train, division, target).select(F.col(division).alias("division"), "target_enc")
    # One row per division: settled here because the fallback, the price table and the writer all read it.
    lookup = freeze(aggregates.division_lookup(train.withColumnRenamed(division, "division"), "division", columns))
    mean = train.agg(F.avg(target).alias("global_mean_log_price"))
    return ServingTables(encoding, lookup, attach_scalar(mean, aggregates.global_row(lookup, columns)), list(order))


def price_table(tables: ServingTables, land_types: Sequence[str], predictor: Callable[[DataFrame], DataFrame],
                size_column: str = "land_size", perches: float = fv.REFERENCE_PERCHES) -> DataFrame:
    """log_price for every (division or fallback, land type): division (NULL = fallback), land_type, listing_count, log_price.

    A quote never depends on the requested size, so the model scores this table once instead of every request.
    `predictor` adds log_price to a table holding target_enc, the feature medians and the land-type flags.
    """
    known = tables.lookup.join(maybe_broadcast(tables.encoding), "division")
    columns = [c for c in tables.fallback.columns if c != "global_mean_log_price"]
    fallback = tables.fallback.select(
        F.lit(None).cast(known.schema["division"].dataType).alias("division"), F.lit(0).cast("long").alias("listing_count"),
        *columns, F.col("global_mean_log_price").alias("target_enc"))
    rows = known.select(fallback.columns).unionByName(fallback).withColumn("land_type", F.explode(F.array(*[F.lit(v) for v in land_types])))
    rows = rows.withColumn(size_column, F.lit(float(perches)))
    for v in land_types:
        rows = rows.withColumn(v, (F.col("land_type") == v).cast("double"))
    return predictor(rows).select("division", "land_type", "listing_count", "log_price", *[c for c in columns if c != size_column])


def validate_requests(requests: DataFrame, land_types: Sequence[str]) -> DataFrame:
    """Add `error`: the first reason a request cannot be priced, NULL when it can."""
    has_point = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    return requests.withColumn(
        "error",
        F.when(F.col("perches").isNull() | ~(F.col("perches") > 0), "perches must be a positive number")
        .when(~F.col("land_type").isin(list(land_types)), "unknown land type")
        .when(F.col("division").isNull() & ~has_point, "a division or a point is required"))


def save_model(model, path: str) -> None:
    """Write a fitted Spark ML model of log_price to a folder that every executor can reach."""
    model.write().overwrite().save(path)


def load_predictor(model_class, path: str, columns: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """The saved model as the predictor of `price_table`: adds log_price from the given columns, missing ones as 0."""
    model = model_class.load(path)

    def predict(rows: DataFrame) -> DataFrame:
        vector = array_to_vector(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]))
        scored = model.transform(rows.withColumn("features", vector))
        return scored.withColumn("log_price", F.col("prediction")).drop("features", "prediction")

    return predict


def division_key(division: Column) -> Column:
    """The form in which a requested name is looked up: without outer blanks, in lower case."""
    return F.lower(F.trim(division))


def score(requests: DataFrame, prices: DataFrame, land_types: Sequence[str], located: Callable[[DataFrame], DataFrame] | None = None,
          default_land_type: str | None = None, records: DataFrame | None = None) -> DataFrame:
    """Price every request: division, known_division, listing_count, confidence, price_per_perch, total_price, small_plot, error.

    `requests`: division, lat, lon, perches, land_type. `located` adds loc_division, loc_nearest and loc_inside for a
    point. A point outside every modelled polygon is labelled with the nearest division but priced by the fallback row.
    A requested name is compared without outer blanks and in lower case, as the names in `prices` are to be written.
    `records` (one row per division: address, risk profile, flood record) adds its columns for the unit that is asked for.
    """
    if dict(requests.dtypes)["division"] == "string":
        requests = requests.withColumn("division", division_key(F.col("division")))
    start = requests.withColumn("land_type", F.coalesce("land_type", F.lit(default_land_type or land_types[0])))
    checked = validate_requests(start, land_types)
    if located is not None:
        checked = located(checked)
    else:
        for c, kind in (("loc_division", "string"), ("loc_nearest", "string"), ("loc_inside", "boolean")):
            checked = checked.withColumn(c, F.lit(None).cast(kind))
    by_point = F.col("division").isNull()
    kind = prices.schema["division"].dataType
    named = F.when(by_point, F.coalesce("loc_division", "loc_nearest").cast(kind)).otherwise(F.col("division").cast(kind))
    usable = F.when(by_point & ~F.coalesce("loc_inside", F.lit(False)), F.lit(None)).otherwise(named)
    asked = checked.withColumn("__named", named).withColumn("__use", usable)
    known = prices.filter("division IS NOT NULL").select(
        F.col("division").alias("__use"), "land_type", F.col("log_price").alias("__lp"), F.col("listing_count").alias("__lc"))
    fallback = prices.filter("division IS NULL").select("land_type", F.col("log_price").alias("__fb"))
    joined = asked.join(maybe_broadcast(known), ["__use", "land_type"], "left").join(maybe_broadcast(fallback), "land_type", "left")
    log_price = F.when(F.col("error").isNull(), F.coalesce("__lp", "__fb"))
    priced = joined.withColumn("known_division", F.col("__lp").isNotNull()).withColumn(
        "listing_count", F.coalesce("__lc", F.lit(0))).withColumn("log_price", log_price)
    extra = [] if records is None else [c for c in records.columns if c != "division"]
    if records is not None:
        priced = priced.join(maybe_broadcast(records.withColumnRenamed("division", "__named")), "__named", "left")
    return priced.select(
        *[c for c in requests.columns if c not in ("division", "land_type")], F.col("__named").alias("division"), "land_type",
        "known_division", "listing_count", numeric.band_grade(F.col("listing_count")).alias("confidence"),
        "log_price", F.exp("log_price").alias("price_per_perch"), (F.exp("log_price") * F.col("perches")).alias("total_price"),
        (F.col("perches") < fv.SMALL_PLOT_PERCHES).alias("small_plot"), "error", *extra)


def compare_categories(requests: DataFrame, key: str, prices: DataFrame, land_types: Sequence[str],
                       located: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row per request and land type, cheapest first (`position`); every row keeps the request's own known status."""
    spread = requests.drop("land_type").withColumn("land_type", F.explode(F.array(*[F.lit(v) for v in land_types])))
    priced = score(spread, prices, land_types, located)
    return top_k_per_group(priced, [key], [F.col("price_per_perch"), F.col("land_type")], len(land_types), "position").withColumn(
        "land_type_label", text.display_label(F.col("land_type"), "Land_type_"))


def risk_profile(df: DataFrame, keep: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """The risk columns with NaN turned into NULL."""
    return df.select(*keep, *[F.nullif(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in fields])


def flood_share_pct(share: Column, covered: Column) -> Column:
    """Percent to one decimal (half to even), NULL unless more than half of the unit was mapped."""
    return F.when(covered > 0.5, F.bround(share * 100, 1))


def event_record(units: DataFrame, events: Sequence[str], keep: Sequence[str], years: str) -> DataFrame:
    """Serving record per unit: mapped shares as percent or NULL, recorded years as an array of integers."""
    return units.select(
        *keep, *[flood_share_pct(F.col(f"flooded_share_{e}"), F.col(f"covered_{e}")).alias(f"flooded_pct_{e}") for e in events],
        F.transform(F.filter(F.split(F.trim(years), r"\s+"), lambda y: y != ""), lambda y: y.cast("int")).alias("years"))


def indication(units: DataFrame, events: Sequence[str], n_years: Column) -> DataFrame:
    """events = mapped shares of at least 1 % plus recorded years; High, Medium, Low or no record."""
    shares = [F.col(f"flooded_share_{e}") for e in events]
    total = sum((F.coalesce((s >= 0.01).cast("int"), F.lit(0)) for s in shares), F.lit(0)) + n_years
    covered = F.lit(False)
    for e in events:
        covered = covered | F.coalesce(F.col(f"covered_{e}") > 0.5, F.lit(False))
    out = units.withColumn("events", total).withColumn("max_share", F.greatest(*shares))
    return out.withColumn("indication", numeric.first_true(
        [((F.col("max_share") >= 0.25) | (F.col("events") >= 3), "High"), (F.col("events") >= 1, "Medium"), (covered, "Low")], "No official record"))


def unit_area_km2(rings: Column) -> Column:
    return F.aggregate(F.transform(rings, lambda ring: geo.spherical_ring_area(ring)), F.lit(0.0), lambda a, x: a + x) / 1e6


def assemble_units(members: DataFrame, unit: str, order: str, name: str, parent: str, known: DataFrame) -> DataFrame:
    """Dissolve members into units without a geometric union: rings, merged bbox, sorted member and parent lists, modelled.

    `known` lists the units the model can price; the rest stay in the table as unmodelled.
    """
    merged = members.groupBy(unit).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, "rings"))), lambda m: m["rings"])).alias("rings"),
        F.array_sort(F.collect_set(name)).alias("members"), F.array_sort(F.collect_set(parent)).alias("parents"))
    flagged = merged.join(maybe_broadcast(known.select(unit).distinct().withColumn("modelled", F.lit(True))), unit, "left")
    return flagged.na.fill(False, ["modelled"]).withColumn("bbox", geo.ring_bbox(F.col("rings"))).withColumn("area_km2", unit_area_km2(F.col("rings")))


def publish_checks(members: DataFrame, unit: str, pcode: str, centroids: DataFrame, encoded: DataFrame, stated_area: DataFrame, area: str,
                   tolerance: float = 0.01) -> DataFrame:
    """Checks table (check, n, fatal, ok): no polygon, encoded without centroid, demoted, polygon claimed twice, no stated
    area, area off. `members`: unit, pcode, rings; only non-fatal checks may have n > 0 (`expect.enforce` raises)."""
    units = members.select(unit).distinct()
    claimed = members.groupBy(pcode).agg(F.count_distinct(unit).alias("n")).filter("n > 1")
    built = members.groupBy(unit).agg(F.sum(unit_area_km2(F.col("rings"))).alias("__built"))
    against = built.join(stated_area.select(unit, F.col(area).alias("__want")), unit, "left")
    count = lambda df, label: df.agg(F.count("*").alias(label))
    stats = count(encoded.select(unit).join(units, unit, "left_anti"), "a")
    for part in (
        count(encoded.select(unit).join(centroids.select(unit), unit, "left_anti"), "b"),
        count(centroids.select(unit).join(encoded.select(unit), unit, "left_anti"), "c"), count(claimed, "d"),
        against.agg(F.count_if(F.col("__want").isNull()).alias("e"),
                    F.count_if((F.col("__want") > 0) & (F.abs(F.col("__built") - F.col("__want")) / F.col("__want") > tolerance)).alias("f")),
    ):
        stats = attach_scalar(stats, part)
    listed = [("no polygon", "a", True), ("encoded without centroid", "b", True), ("centroid without encoding", "c", False),
              ("polygon claimed twice", "d", True), ("no stated area", "e", True), ("area off", "f", True)]
    return stack_rows(stats, [(F.lit(n), F.col(c), F.lit(fatal), F.lit(not fatal) | (F.col(c) == 0), F.col(c).cast("string")) for n, c, fatal in listed],
                      ["check", "n", "fatal", "ok", "detail"])


def request_points(located: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Adapter from `spatial.locate` output to the loc_* columns `score` reads."""
    return located.select(*keep, F.col("division").alias("loc_division"), F.col("nearest_division").alias("loc_nearest"), F.col("known").alias("loc_inside"))
