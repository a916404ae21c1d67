"""Domain views over the driver tables, as DataFrames and as the matching SQL, built by plain arithmetic."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelytics import fixed_values as fv
from parcelytics.functions import text


def view_listings(t) -> DataFrame:
    li = t.lineitem
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_suppkey").alias("division"),
        F.col("l_quantity").alias("land_size"),
        F.col("l_extendedprice").alias("total_price"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        F.concat_ws("_", "l_returnflag", "l_linestatus").alias("land_type"),
        F.when(F.col("l_linenumber") % 3 == 0, "total").when(F.col("l_linenumber") % 3 == 1, "per perch")
        .otherwise("per acre").alias("price_scale"),
        F.when(F.col("l_orderkey") % 17 != 0, F.col("l_shipdate")).alias("posted"),
        ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 5).alias("fold"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
    )


def with_point(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("lat", 6.70 + (F.col(key) * 37 % 350) / 1000.0).withColumn(
        "lon", 79.80 + (F.col(key) * 91 % 450) / 1000.0
    )


def view_points(t) -> DataFrame:
    base = t.customer.select(
        F.col("c_custkey").alias("point_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")
    )
    return with_point(base, "point_id")


def view_amenities(t) -> DataFrame:
    base = t.part.select(
        F.col("p_partkey").alias("amenity_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("category")
    )
    return with_point(base, "amenity_id")


def view_units(t) -> DataFrame:
    """Admin units: suppliers with a coordinate and an area."""
    base = t.supplier.select(
        F.col("s_suppkey").alias("unit_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"),
        (1.0 + F.abs(F.col("s_acctbal")) / 100).alias("area"),
    )
    return with_point(base, "unit_id")


def view_boxes(t) -> DataFrame:
    """One rectangle per nation: cell (key % 5, key div 5) of the covered area."""
    key = F.col("n_nationkey")
    corner = lambda lon, lat: F.struct(lon.alias("lon"), lat.alias("lat"))
    box = t.nation.select(
        key.cast("long").alias("poly_id"), F.col("n_name").alias("address"), (key % 4 != 3).alias("modelled"),
        (79.80 + (key % 5) * 0.09).alias("x0"), (6.70 + F.floor(key / 5) * 0.07).alias("y0"),
    ).withColumn("x1", F.col("x0") + 0.09).withColumn("y1", F.col("y0") + 0.07)
    ring = F.array(
        corner(F.col("x0"), F.col("y0")), corner(F.col("x1"), F.col("y0")),
        corner(F.col("x1"), F.col("y1")), corner(F.col("x0"), F.col("y1")),
    )
    return box.withColumn("rings", F.array(ring))


def view_triangles(t) -> DataFrame:
    """The lower-left half of every box."""
    first = F.col("rings")[0]
    return t.boxes.withColumn("rings", F.array(F.array(first[0], first[1], first[3])))


def view_requests(t) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("division"),
        (1 + F.col("o_orderkey") % 40).cast("double").alias("perches"),
        F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("created_at"),
        F.col("o_totalprice").alias("amount"),
    )


def view_runs(t) -> DataFrame:
    """Experiment runs: config = priority, seed = order year, metric = mean order value in thousands."""
    return t.orders.groupBy(
        F.col("o_orderpriority").alias("config"), F.year("o_orderdate").cast("long").alias("seed")
    ).agg((F.avg("o_totalprice") / 1000).alias("metric"))


def view_pixels(t) -> DataFrame:
    return t.lineitem.select(
        F.year("l_shipdate").cast("long").alias("scene"), (F.col("l_partkey") % 40).alias("x"),
        (F.col("l_suppkey") % 10).alias("y"), (F.col("l_extendedprice") / 10).alias("red"),
        (F.col("l_quantity") * 300).alias("nir"), ((F.col("l_discount") + F.col("l_tax")) * 50000).alias("swir"),
        (40000 + F.col("l_quantity") * 40).alias("thermal"), (F.col("l_orderkey") % 256).alias("qa"),
    )


def view_gazetteer(t) -> DataFrame:
    """Place dictionary: a word, a two-word and a three-word name from every benchmark item."""
    words = t.benchmark.select("item_id", text.latin_tokens(F.col("text")).alias("w")).filter(F.size("w") >= 8)
    names = words.select(
        "item_id",
        F.posexplode(F.array(*[F.array_join(F.slice("w", start, n), " ") for start, n in ((8, 1), (1, 2), (4, 3))]))
        .alias("slot", "name"),
    )
    return names.select(
        (F.col("item_id") * 3 + F.col("slot")).alias("place_id"), "name", text.latin_key(F.col("name")).alias("key"),
        (1.0 + F.col("item_id") % 7).alias("area"),
    )


SOUND_STEPS = [*fv.ASPIRATES, *fv.VOWELS, ("w", "v")]


def sound_sql(expression: str) -> str:
    out = f"lower({expression})"
    for old, new in SOUND_STEPS:
        out = f"replace({out}, '{old}', '{new}')"
    return squeeze_sql(out)


def squeeze_sql(expression: str) -> str:
    """Doubled letters to one, without back-references."""
    return (
        f"array_to_string(list_transform(list_filter(list_zip(string_split({expression}, ''), [''] || string_split({expression}, '')),"
        " lambda p: p[1] IS NOT NULL AND p[1] <> p[2]), lambda p: p[1]), '')"
    )


def tokens_sql(column: str) -> str:
    return (
        f"list_filter(string_split(regexp_replace(coalesce({column}, ''), '[^\\p{{L}}\\p{{N}}_\\x{{0D80}}-\\x{{0DFF}}]+', ' ', 'g'), ' '),"
        " lambda w: w <> '' AND NOT regexp_matches(w, '^\\p{Nd}+$'))"
    )


def latin_sql(column: str) -> str:
    return f"list_filter({tokens_sql(column)}, lambda w: regexp_matches(w, '[a-zA-Z]'))"


VIEW_SQL = {
    "doc_tokens": f"""SELECT doc_id, lang, pos, tok, {sound_sql('tok')} AS key, lower(tok) AS low FROM (
        SELECT doc_id, lang, unnest(w) AS tok, unnest(range(1, len(w) + 1)) AS pos FROM (
        SELECT doc_id, lang, {latin_sql('text')} AS w FROM documents))""",
    "gazetteer": f"""SELECT item_id * 3 + slot AS place_id, name, array_to_string(list_transform(string_split(name, ' '), lambda x: {sound_sql('x')}), ' ') AS key,
        CAST(1 + item_id % 7 AS DOUBLE) AS area FROM (
        SELECT item_id, unnest([0, 1, 2]) AS slot, unnest([w[8], array_to_string(w[1:2], ' '), array_to_string(w[4:6], ' ')]) AS name FROM (
        SELECT item_id, {latin_sql('text')} AS w FROM benchmark) WHERE len(w) >= 8)""",
    "listings": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_suppkey AS division,
        l_quantity AS land_size, l_extendedprice AS total_price, l_extendedprice / l_quantity AS unit_price,
        l_returnflag || '_' || l_linestatus AS land_type,
        CASE l_linenumber % 3 WHEN 0 THEN 'total' WHEN 1 THEN 'per perch' ELSE 'per acre' END AS price_scale,
        CASE WHEN l_orderkey % 17 <> 0 THEN l_shipdate END AS posted,
        (l_orderkey * 7 + l_linenumber) % 5 AS fold, l_discount AS discount, l_tax AS tax FROM lineitem""",
    "points": """SELECT c_custkey AS point_id, c_name AS name, c_nationkey AS nation,
        CAST(6.70 AS DOUBLE) + (c_custkey * 37 % 350) / CAST(1000 AS DOUBLE) AS lat,
        CAST(79.80 AS DOUBLE) + (c_custkey * 91 % 450) / CAST(1000 AS DOUBLE) AS lon FROM customer""",
    "amenities": """SELECT p_partkey AS amenity_id, p_name AS name, p_brand AS category,
        CAST(6.70 AS DOUBLE) + (p_partkey * 37 % 350) / CAST(1000 AS DOUBLE) AS lat,
        CAST(79.80 AS DOUBLE) + (p_partkey * 91 % 450) / CAST(1000 AS DOUBLE) AS lon FROM part""",
    "units": """SELECT s_suppkey AS unit_id, s_name AS name, s_nationkey AS nation,
        CAST(1 AS DOUBLE) + abs(s_acctbal) / 100 AS area,
        CAST(6.70 AS DOUBLE) + (s_suppkey * 37 % 350) / CAST(1000 AS DOUBLE) AS lat,
        CAST(79.80 AS DOUBLE) + (s_suppkey * 91 % 450) / CAST(1000 AS DOUBLE) AS lon FROM supplier""",
    "boxes": """SELECT CAST(n_nationkey AS BIGINT) AS poly_id, n_name AS address, n_nationkey % 4 <> 3 AS modelled,
        CAST(79.80 AS DOUBLE) + (n_nationkey % 5) * CAST(0.09 AS DOUBLE) AS x0,
        CAST(6.70 AS DOUBLE) + (n_nationkey // 5) * CAST(0.07 AS DOUBLE) AS y0,
        CAST(79.80 AS DOUBLE) + (n_nationkey % 5) * CAST(0.09 AS DOUBLE) + CAST(0.09 AS DOUBLE) AS x1,
        CAST(6.70 AS DOUBLE) + (n_nationkey // 5) * CAST(0.07 AS DOUBLE) + CAST(0.07 AS DOUBLE) AS y1 FROM nation""",
    "requests": """SELECT o_orderkey AS request_id, o_custkey AS division, CAST(1 + o_orderkey % 40 AS DOUBLE) AS perches,
        o_orderpriority AS priority, o_orderdate AS created_at, o_totalprice AS amount FROM orders""",
    "runs": """SELECT o_orderpriority AS config, CAST(year(o_orderdate) AS BIGINT) AS seed,
        avg(o_totalprice) / 1000 AS metric FROM orders GROUP BY 1, 2""",
    "pixels": """SELECT CAST(year(l_shipdate) AS BIGINT) AS scene, l_partkey % 40 AS x, l_suppkey % 10 AS y,
        l_extendedprice / 10 AS red, l_quantity * 300 AS nir, (l_discount + l_tax) * 50000 AS swir,
        40000 + l_quantity * 40 AS thermal, l_orderkey % 256 AS qa FROM lineitem""",
}


def expand_sql(sql: str) -> str:
    """Prepend the view definitions the statement mentions."""
    used = [name for name in VIEW_SQL if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b|,\s*{name}\s+(?:AS\s+)?[a-z]\b", sql)]
    if not used:
        return sql.strip()
    head = ",\n".join(f"{name} AS ({VIEW_SQL[name]})" for name in used)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head},\n{body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH"):
        return f"WITH {head},\n{body[len('WITH'):]}"
    return f"WITH {head}\n{body}"


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str, radius: float) -> str:
    return (
        f"(2 * CAST({radius} AS DOUBLE) * asin(sqrt(sin(radians({lat2} - {lat1}) / 2) ** 2"
        f" + cos(radians({lat1})) * cos(radians({lat2})) * sin(radians({lon2} - {lon1}) / 2) ** 2)))"
    )


def blocks_sql(pairs: str, cutoff: float = 0.0) -> str:
    """CTEs `mr(a, b, ratio)`: matching-block ratio of the (a, b) pairs of a query, for those that can reach the cutoff.

    Each step takes the longest substring of x that y contains (the first of them, at its first place in y) and goes on
    with what is left and right of it. Pairs too far apart by edit distance (counted in bytes) can't reach the cutoff.
    """
    return f"""cand AS (SELECT DISTINCT a, b FROM ({pairs}) WHERE levenshtein(a, b) <= {1 - cutoff} * (length(a) + length(b)) + 1e-9 + strlen(a) + strlen(b) - length(a) - length(b)),
blk AS (SELECT a, b, a AS x, b AS y, 0 AS k FROM cand
  UNION ALL SELECT a, b, unnest([substr(x, 1, i - 1), substr(x, i + n)]), unnest([substr(y, 1, j - 1), substr(y, j + n)]), unnest([n, 0]) FROM (
    SELECT *, instr(y, substr(x, i, n)) AS j FROM (
      SELECT *, (w + 999) // 1000 AS n, (w + 999) // 1000 * 1000 - w AS i FROM (
        SELECT a, b, x, y, list_max(flatten([[CASE WHEN contains(y, substr(x, p, q)) THEN q * 1000 - p END FOR q IN range(1, length(x) - p + 2)] FOR p IN range(1, length(x) + 1)])) AS w
        FROM blk WHERE x <> '' AND y <> '') WHERE w IS NOT NULL))),
mr AS (SELECT a, b, 2 * sum(k) / CAST(length(a) + length(b) AS DOUBLE) AS ratio FROM blk GROUP BY a, b)"""
