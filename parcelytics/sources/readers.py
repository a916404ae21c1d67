"""Readers: tables with a declared schema, files with a provenance header, feature collections, event records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parcelytics.functions import geo
from parcelytics.plans.scale import attach_stats, is_small, keep_first, maybe_broadcast, with_positions

GEOMETRY_SCHEMA = (
    "struct<features:array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>>"
)

#: How a feature begins in the files of most writers.
FEATURE_BEGIN = '{"type":"Feature",'


def load_table(spark: SparkSession, path: str, columns: Sequence[str], schema: StructType | str | None = None, fmt: str = "parquet") -> DataFrame:
    """Scan with a column whitelist; text formats need a declared schema (types are never guessed)."""
    reader = spark.read
    if fmt != "parquet" and schema is None:
        raise ValueError("declare a schema for text formats")
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(path).select(*columns)


def with_source_row_id(df: DataFrame, order: Sequence[Column], name: str = "source_row_id") -> DataFrame:
    """0-based position by a total order: the stable identity when the natural id collides."""
    return with_positions(df, [], order, name).withColumn(name, F.col(name) - 1)


def read_commented_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV body below `# key=value` lines."""
    return spark.read.schema(schema).option("header", True).option("comment", "#").csv(path)


def read_provenance(spark: SparkSession, path: str) -> DataFrame:
    """The `# key=value` header lines as (key, value)."""
    lines = spark.read.text(path).filter(F.col("value").startswith("#"))
    parts = F.regexp_extract("value", r"^#\s*([^=]+?)\s*=\s*(.*)$", 1), F.regexp_extract("value", r"^#\s*([^=]+?)\s*=\s*(.*)$", 2)
    return lines.select(parts[0].alias("key"), parts[1].alias("value")).filter("key <> ''")


def outer_rings(kind: Column, coordinates: Column) -> Column:
    """Outer rings (holes dropped) of a Polygon or MultiPolygon coordinate text as array<array<struct(lon, lat)>>."""
    polygon = F.from_json(coordinates, "array<array<array<double>>>")
    multi = F.from_json(coordinates, "array<array<array<array<double>>>>")
    raw = F.when(kind == "Polygon", F.array(polygon[0])).when(kind == "MultiPolygon", F.transform(multi, lambda p: p[0]))
    return F.transform(
        raw, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))
    )


def load_geojson(documents: DataFrame, text: str, where: Column | None = None) -> DataFrame:
    """One row per feature of a feature-collection text: properties map, outer rings, bbox."""
    return _shaped(documents.select(F.explode(F.from_json(F.col(text), GEOMETRY_SCHEMA)["features"]).alias("f")), where)


def _shaped(parsed: DataFrame, where: Column | None) -> DataFrame:
    flat = parsed.select(
        F.col("f.properties").alias("properties"),
        outer_rings(F.col("f.geometry.type"), F.col("f.geometry.coordinates")).alias("rings"),
    )
    if where is not None:
        flat = flat.filter(where)
    return flat.filter(F.col("rings").isNotNull()).withColumn("bbox", geo.ring_bbox(F.col("rings")))


def load_feature_files(spark: SparkSession, path: str, where: Column | None = None, begin: str = FEATURE_BEGIN) -> DataFrame:
    """As `load_geojson` for files of any size: one file is read by many tasks, each the features that begin in its split.

    `begin` is the text with which every feature of the files begins; it parts the records of the text reader, which finds them
    from any offset. Quotes inside a JSON text are escaped, so names and notes cannot look like it. Files without it are read
    whole; a file that has features of another form beside it, or a feature that cannot be read, is an error.
    """
    pieces = spark.read.option("lineSep", begin).text(path)
    feature = GEOMETRY_SCHEMA.removeprefix("struct<features:array<").removesuffix(">>")
    one = F.from_json(F.concat(F.lit(begin), "value"), feature)
    other = F.regexp_like("value", F.lit(r'"type"\s*:\s*"Feature"'))
    head = F.regexp_like("value", F.lit(r'"type"\s*:\s*"FeatureCollection"|^\s*\{\s*"features"\s*:'))
    whole = F.from_json("value", GEOMETRY_SCHEMA)["features"]
    read = F.when(head, F.when(other & (F.coalesce(F.size(whole), F.lit(0)) < 1), F.raise_error(F.lit("a feature begins in another form"))).otherwise(whole))
    broken = F.when(other, "a feature begins in another form").when(one.isNull() | one["geometry"].isNull(), "a feature cannot be read")
    read = read.when(broken.isNotNull(), F.raise_error(broken)).otherwise(F.array(one))
    return _shaped(pieces.filter(F.trim("value") != "").select(F.explode(read).alias("f")), where)


def load_flag_events(
    records: DataFrame, kind: str, classes: dict[str, str], numeric: Sequence[str], blank_to_null: Sequence[str],
    extension: DataFrame | None = None, key: str | None = None,
) -> DataFrame:
    """Keep the mapped event kinds, coerce numbers (NULL on failure), blank text to NULL, left-look-up an extension."""
    mapping = F.create_map(*[F.lit(x) for pair in classes.items() for x in pair])
    out = records.filter(F.col(kind).isin(list(classes))).withColumn("event_class", F.try_element_at(mapping, F.col(kind)))
    for c in numeric:
        out = out.withColumn(c, F.expr(f"try_cast(`{c}` AS DOUBLE)"))
    for c in blank_to_null:
        out = out.withColumn(c, F.nullif(F.trim(c), F.lit("")))
    return out if extension is None else out.join(maybe_broadcast(extension), key, "left")


def explode_vertices(ways: DataFrame, key: str, geometry: str) -> DataFrame:
    """One row per vertex with its position."""
    return ways.select(key, F.posexplode(geometry).alias("position", "v")).select(key, "position", "v.*")


def names_match(tags: Column, needle: str) -> Column:
    """Case-folded search over every tag whose key starts with 'name'."""
    named = F.map_values(F.map_filter(tags, lambda k, _: k.startswith("name")))
    return F.contains(F.lower(F.array_join(named, " ")), F.lit(needle.lower()))


def fill_down(df: DataFrame, partition: Sequence[str], order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """Spreadsheet forward fill inside each sheet.

    A small input uses a window. Otherwise a running count numbers the blocks that start at a non-missing cell,
    and the block's one value travels to its rows by aggregate-then-join, so a huge sheet is spread over tasks.
    """
    if is_small(df):
        frame = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.last(c, ignorenulls=True).over(frame).alias(f"__f_{c}") for c in columns]).select(
            *[F.col(f"__f_{c}").alias(c) if c in columns else F.col(c) for c in df.columns]
        )
    blocks = {f"__b_{c}": F.col(c).isNotNull().cast("long") for c in columns}
    out = with_positions(df, partition, order, "__rn", blocks)
    for c in columns:
        out = attach_stats(out, [*partition, f"__b_{c}"], F.max(c).alias(f"__f_{c}"))
    return out.select(*[F.col(f"__f_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def union_sources(sources: dict[str, DataFrame], expected: Sequence[str], key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, report): per-source lists concatenated and de-duplicated (earliest source wins), counts, missing sources."""
    union = None
    for i, (name, df) in enumerate(sources.items()):
        tagged = df.withColumn("source", F.lit(name)).withColumn("__i", F.lit(i))
        union = tagged if union is None else union.unionByName(tagged, allowMissingColumns=True)
    return _unique_by_source(union, expected, key, F.col("__i"))


def union_by_source(rows: DataFrame, expected: Sequence[str], key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """As `union_sources` for lists that stand in one table with a `source` column, in one scan; names in order win."""
    return _unique_by_source(rows.withColumn("__i", F.col("source")), expected, key, F.col("__i"))


def _unique_by_source(union: DataFrame, expected: Sequence[str], key: Sequence[str], first: Column) -> tuple[DataFrame, DataFrame]:
    unique = keep_first(union, list(key), [first]).drop("__i")
    counts = union.groupBy("source").agg(F.count("*").alias("fetched"))
    names = union.sparkSession.createDataFrame([(n,) for n in expected], "source string")
    kept = unique.groupBy("source").agg(F.count("*").alias("kept"))
    report = names.join(counts, "source", "left").join(kept, "source", "left").select(
        "source", F.coalesce("fetched", F.lit(0)).alias("fetched"), F.coalesce("kept", F.lit(0)).alias("kept"),
        F.col("fetched").isNull().alias("unavailable"),
    )
    return unique, report
