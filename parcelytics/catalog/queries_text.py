"""Sources, sinks and text functions."""

import uuid

from pyspark.sql import functions as F

from parcelytics import fixed_values as fv
from parcelytics.catalog.registry import query
from parcelytics.catalog.registry import rounded as r
from parcelytics.catalog.views import latin_sql, sound_sql, tokens_sql
from parcelytics.functions import numeric, text
from parcelytics.operators import matching, rules
from parcelytics.session import ensure_checkpoint_dir
from parcelytics.sources import readers, writers

COLS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def scratch(t, label: str) -> str:
    """A fresh folder in the shared checkpoint location."""
    return f"{ensure_checkpoint_dir(t.spark)}/{label}-{uuid.uuid4().hex}"


@query("A1_load_table", "SELECT l_orderkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem")
def _(t):
    return readers.load_table(t.spark, f"{t.folder}/lineitem.parquet", ["l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice"])


@query("A2_with_source_row_id", f"SELECT row_number() OVER (ORDER BY {', '.join(COLS)}) - 1 AS source_row_id, {', '.join(COLS[:6])} FROM lineitem")
def _(t):
    out = readers.with_source_row_id(t.lineitem.select(*COLS), [F.col(c) for c in COLS])
    return out.select(F.col("source_row_id").cast("long").alias("source_row_id"), *COLS[:6])


@query("A3_commented_csv_round_trip", """
SELECT o_orderkey, o_custkey, o_totalprice, 'orders' AS origin FROM orders""")
def _(t):
    path = scratch(t, "commented")
    writers.write_commented_csv(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), path, {"origin": "orders", "rows": "all"})
    body = readers.read_commented_csv(t.spark, path, "o_orderkey long, o_custkey long, o_totalprice double")
    meta = readers.read_provenance(t.spark, path).filter("key = 'origin'").select("value")
    return body.withColumn("origin", meta.scalar())


A4_SQL = """
SELECT address, poly_id % 2 = 0 AS polygon, round(x0, 6) AS min_lon, round(y0, 6) AS min_lat, round(x1, 6) AS max_lon, round(y1, 6) AS max_lat, CAST(4 AS INT) AS n_vertices FROM boxes WHERE modelled"""


def feature_parts(t):
    """Properties and geometry of each box as a feature: single outlines for even ids, lists of one for odd ids."""
    ring = F.transform(F.col("rings")[0], lambda p: F.array(p["lon"], p["lat"]))
    even = F.col("poly_id") % 2 == 0
    properties = F.create_map(F.lit("address"), F.col("address"), F.lit("modelled"), F.col("modelled").cast("string"))
    return properties.alias("properties"), F.when(even, "Polygon").otherwise("MultiPolygon"), even, F.array(ring), F.array(F.array(ring))


def outlines(out):
    key = F.regexp_extract(F.col("properties")["address"], r"(\d+)", 1).cast("long")
    return out.select(
        F.col("properties")["address"].alias("address"), (key % 2 == 0).alias("polygon"),
        *[r(F.col(f"bbox.{c}")).alias(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")],
        F.size(F.col("rings")[0]).alias("n_vertices"),
    )


@query("A4_load_geojson", A4_SQL)
def _(t):
    properties, kind, even, single, multi = feature_parts(t)
    feature = F.struct(properties, F.struct(kind.alias("type"), F.when(even, F.to_json(single)).otherwise(F.to_json(multi)).alias("coordinates")).alias("geometry"))
    texts = t.boxes.groupBy((F.col("poly_id") % 5).alias("g")).agg(
        F.to_json(F.struct(F.collect_list(feature).alias("features"))).alias("body"))
    return outlines(readers.load_geojson(texts, "body", F.col("properties")["modelled"] == "true"))


@query("A4_load_feature_files", A4_SQL)
def _(t):
    """Files of features without line ends, as other tools write them."""
    properties, kind, even, single, multi = feature_parts(t)
    shape = F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":'), F.when(even, F.to_json(single)).otherwise(F.to_json(multi)), F.lit("}"))
    feature = F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(properties), F.lit(',"geometry":'), shape, F.lit("}"))
    path = scratch(t, "features")
    t.boxes.select(feature).write.option("lineSep", ",\n").text(path)
    return outlines(readers.load_feature_files(t.spark, path, F.col("properties")["modelled"] == "true"))


@query("A5_load_flag_events", """
SELECT event_id, CASE event_type WHEN 'error' THEN 'flood' ELSE 'heavy rain' END AS event_class, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k,
  try_cast(CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS v, nullif(trim(CASE WHEN event_id % 5 = 0 THEN '  ' ELSE event_type END), '') AS note, label
FROM events LEFT JOIN (SELECT n_nationkey AS user_id, n_name AS label FROM nation) USING (user_id) WHERE event_type IN ('error', 'click')""")
def _(t):
    records = t.events.select(
        "event_id", "user_id", F.col("event_type").alias("kind"),
        F.get_json_object("props", "$.k").alias("k"),
        F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("v"),
        F.when(F.col("event_id") % 5 == 0, "  ").otherwise(F.col("event_type")).alias("note"),
    )
    extension = t.nation.select(F.col("n_nationkey").cast("long").alias("user_id"), F.col("n_name").alias("label"))
    out = readers.load_flag_events(records, "kind", {"error": "flood", "click": "heavy rain"}, ["k", "v"], ["note"], extension, "user_id")
    return out.select("event_id", "event_class", "k", "v", "note", "label")


@query("A6_explode_osm_vertices", """
WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS position FROM lineitem)
SELECT l_orderkey, CAST(position AS INT) AS position, l_partkey AS x, l_suppkey AS y, contains(lower(CASE WHEN l_orderkey % 3 = 0 THEN 'Kelani Ganga' ELSE 'canal' END || ' ' || 'river'), 'kelani') AS hit FROM v""")
def _(t):
    point = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    ways = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(point)).alias("g")).withColumn(
        "geometry", F.transform("g", lambda p: F.struct(p["l_partkey"].alias("x"), p["l_suppkey"].alias("y")))
    ).withColumn("tags", F.create_map(
        F.lit("name"), F.when(F.col("l_orderkey") % 3 == 0, "Kelani Ganga").otherwise("canal"), F.lit("name:en"), F.lit("river"), F.lit("type"), F.lit("kelani")))
    hits = ways.select("l_orderkey", readers.names_match(F.col("tags"), "Kelani").alias("hit"))
    return readers.explode_vertices(ways, "l_orderkey", "geometry").join(hits, "l_orderkey")


@query("A7_fill_down", """
SELECT event_id, user_id, last_value(CASE WHEN event_id % 4 = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS event_type FROM events""")
def _(t):
    sparse = t.events.select("event_id", "user_id", "ts", F.when(F.col("event_id") % 4 == 0, F.col("event_type")).alias("event_type"))
    return readers.fill_down(sparse, ["user_id"], [F.col("ts"), F.col("event_id")], ["event_type"]).drop("ts")


@query("A8_write_category_multi_sink", """
SELECT land_type, CASE WHEN land_size < 3 THEN 'small' ELSE 'kept' END AS drop_rule, count(*) AS n FROM listings GROUP BY 1, 2""")
def _(t):
    path = scratch(t, "cleaned")
    flagged = rules.apply_rules(t.listings.select("land_type", "land_size"), [("small", F.col("land_size") < 3)])
    writers.write_cleaned(flagged, path)
    writers.write_category(flagged, f"{path}/by_type", "land_type")
    back = t.spark.read.parquet(f"{path}/by_type")
    return back.groupBy("land_type", F.coalesce("drop_rule", F.lit("kept")).alias("drop_rule")).agg(F.count("*").alias("n"))


@query("A9_append_run_log", """
SELECT config, seed, round(metric, 6) AS metric, d AS dataset FROM runs, (SELECT unnest(['first', 'second']) AS d)""")
def _(t):
    path = scratch(t, "runlog")
    for dataset in ("first", "second"):
        writers.append_run_log(t.runs, path, dataset, "2024-01-01 00:00:00")
    return t.spark.read.parquet(path).select("config", "seed", r("metric"), "dataset")


@query("A10_union_sources_with_failures", """
WITH s AS (SELECT p_brand AS source, p_name FROM part),
k AS (SELECT p_name, min(source) AS source FROM s GROUP BY 1)
SELECT e.source, coalesce(f.n, 0) AS fetched, coalesce(g.n, 0) AS kept, f.n IS NULL AS unavailable FROM (SELECT DISTINCT source FROM s UNION SELECT 'Brand#99') e
LEFT JOIN (SELECT source, count(*) AS n FROM s GROUP BY 1) f ON e.source = f.source LEFT JOIN (SELECT source, count(*) AS n FROM k GROUP BY 1) g ON e.source = g.source""")
def _(t):
    rows = t.part.select(F.col("p_brand").alias("source"), "p_name")
    brands = [x["source"] for x in rows.select("source").distinct().collect()]
    return readers.union_by_source(rows, [*brands, "Brand#99"], ["p_name"])[1]


def b1_names(t):
    k = F.col("p_partkey") % 8
    name = F.initcap("p_name")
    return t.part.select("p_partkey", F.when(k == 0, F.concat(name, F.lit(" North"))).when(k == 1, F.concat(name, F.lit("  New Town")))
        .when(k == 2, F.concat(name, F.lit(" A"))).when(k == 3, F.concat(F.lit("Maha "), name, F.lit("-West B")))
        .when(k == 4, F.lit("Havelock Town")).when(k == 5, F.concat(F.lit("Ihala "), name, F.lit(" East Town 'C'"))).otherwise(name).alias("name"))


def b1_sql(rounds=5):
    name = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
    base = f"""WITH s0 AS (SELECT p_partkey, trim(regexp_replace(CASE p_partkey % 8 WHEN 0 THEN {name} || ' North' WHEN 1 THEN {name} || '  New Town' WHEN 2 THEN {name} || ' A'
      WHEN 3 THEN 'Maha ' || {name} || '-West B' WHEN 4 THEN 'Havelock Town' WHEN 5 THEN 'Ihala ' || {name} || ' East Town ''C''' ELSE {name} END, '\\s+', ' ', 'g')) AS s, '' AS q FROM part)"""
    letter, town = "^(.+?)[\\s\\-]+''?([ABC])''?$", "(?i)^(.+?)\\s+((?:new\\s+)?town)$"
    cardinal, prefix = "(?i)^(.+?)[\\s\\-]+(north|south|east|west|central)$", "(?i)^(ihala|pahala|maha|kuda|megoda|meda|udu)\\s+(.+)$"
    ex = lambda p, i: f"regexp_extract(s, '{p}', {i})"
    for i in range(rounds):
        base += f""", s{i + 1} AS (SELECT p_partkey, CASE WHEN q = '' AND lower(s) = 'havelock town' THEN s WHEN {ex(letter, 1)} <> '' THEN trim({ex(letter, 1)}, ' -')
          WHEN {ex(town, 1)} <> '' THEN trim({ex(town, 1)}, ' -') WHEN {ex(cardinal, 1)} <> '' THEN trim({ex(cardinal, 1)}, ' -') WHEN {ex(prefix, 2)} <> '' THEN trim({ex(prefix, 2)}, ' -') ELSE s END AS s,
          CASE WHEN q = '' AND lower(s) = 'havelock town' THEN q WHEN {ex(letter, 1)} <> '' THEN q || '|' || {ex(letter, 2)} WHEN {ex(town, 1)} <> '' THEN q || '|' || {ex(town, 2)}
          WHEN {ex(cardinal, 1)} <> '' THEN q || '|' || {ex(cardinal, 2)} WHEN {ex(prefix, 2)} <> '' THEN q || '|' || {ex(prefix, 1)} ELSE q END AS q FROM s{i})"""
    return base + f" SELECT p_partkey, s AS base, q AS qualifiers, true AS settled FROM s{rounds}"


@query("B1_reduce_name", b1_sql())
def _(t):
    out = b1_names(t).withColumn("r", text.reduce_name(F.col("name")))
    joined = F.concat(F.when(F.size("r.qualifiers") > 0, "|").otherwise(""), F.array_join("r.qualifiers", "|"))
    return out.select("p_partkey", F.col("r.base").alias("base"), joined.alias("qualifiers"), F.col("r.settled").alias("settled"))


@query("B2_sound_key", f"SELECT DISTINCT tok, {sound_sql('tok')} AS key FROM (SELECT unnest({tokens_sql('text')}) AS tok FROM documents)")
def _(t):
    words = t.documents.select(F.explode(text.tokenize(F.col("text"))).alias("tok")).distinct()
    return words.select("tok", text.sound_key(F.col("tok")).alias("key"))


@query("B3_tokenize", f"SELECT doc_id, len(w) AS n_tokens, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, {tokens_sql('text')} AS w FROM documents)")
def _(t):
    out = t.documents.select("doc_id", text.tokenize(F.col("text")).alias("w"))
    return out.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.md5(F.encode(F.array_join("w", " "), "UTF-8")).alias("digest"))


@query("B4_latin_key", f"SELECT doc_id, md5(array_to_string(list_transform({latin_sql('text')}, lambda x: {sound_sql('x')}), ' ')) AS digest FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(F.encode(text.latin_key(F.col("text")), "UTF-8")).alias("digest"))


def b5_sql(rounds=3):
    forms = [w for q in fv.SCRIPT_SUFFIXES for w in (q, q[:-1]) if len(w) >= 2]
    suffix = "CASE " + " ".join(f"WHEN ends_with(s, '{w}') AND contains(s, ' ') AND trim(left(s, length(s) - {len(w)})) <> '' THEN trim(left(s, length(s) - {len(w)}))" for w in forms) + " ELSE s END"
    sql = """WITH s0 AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name || ' උතුර' WHEN 1 THEN 'මහ ' || p_name || ' නැගෙනහි' WHEN 2 THEN p_name || ' දකුණ පහළ' WHEN 3 THEN 'ඉහළ ' || p_name || 'මැද' ELSE p_name END AS s FROM part)"""
    for i in range(rounds):
        sql += f", t{i}_0 AS (SELECT p_partkey, {suffix} AS s FROM s{i})"
        for j, q in enumerate(fv.SCRIPT_PREFIXES):
            name = f"s{i + 1}" if j == len(fv.SCRIPT_PREFIXES) - 1 else f"t{i}_{j + 1}"
            sql += f", {name} AS (SELECT p_partkey, CASE WHEN starts_with(s, '{q} ') THEN trim(substring(s, {len(q) + 1})) ELSE s END AS s FROM t{i}_{j})"
    return sql + f" SELECT p_partkey, s AS base FROM s{rounds}"


@query("B5_script_base", b5_sql())
def _(t):
    k, name = F.col("p_partkey") % 5, F.col("p_name")
    mixed = F.when(k == 0, F.concat(name, F.lit(" උතුර"))).when(k == 1, F.concat(F.lit("මහ "), name, F.lit(" නැගෙනහි"))).when(
        k == 2, F.concat(name, F.lit(" දකුණ පහළ"))).when(k == 3, F.concat(F.lit("ඉහළ "), name, F.lit("මැද"))).otherwise(name)
    return t.part.select("p_partkey", text.script_base(mixed).alias("base"))


@query("B6_norm_key", r"""
SELECT c_custkey, lower(trim(regexp_replace('  ' || c_name || '   X ', '\s+', ' ', 'g'))) AS squeezed, regexp_replace(lower(c_name), '[^a-z]', '', 'g') AS letters,
  lower(trim(regexp_replace(replace(c_mktsegment || '-a  b', '-', ' '), '\s+', ' ', 'g'))) AS spaced FROM customer""")
def _(t):
    return t.customer.select(
        "c_custkey", text.norm_key(F.concat(F.lit("  "), "c_name", F.lit("   X "))).alias("squeezed"),
        text.letters_only(F.col("c_name")).alias("letters"), text.hyphens_to_spaces(F.concat("c_mktsegment", F.lit("-a  b"))).alias("spaced"))


@query("B7_norm_address", r"""
SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(lower(url || ' No. 5, ' || html), '[^a-z0-9]+', ' ', 'g'), '\b(no|nos|sri|lanka)\b', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM pages""")
def _(t):
    address = text.norm_address(F.concat("url", F.lit(" No. 5, "), "html"))
    return t.pages.select("page_id", F.md5(F.encode(address, "UTF-8")).alias("digest"))


@query("B8_ngrams", """
SELECT a.doc_id, a.tok || ' ' || b.tok AS gram, count(*) AS n FROM doc_tokens a JOIN doc_tokens b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1
WHERE NOT (a.low IN (SELECT unnest({filler})) AND b.low IN (SELECT unnest({filler}))) GROUP BY 1, 2""".replace("{filler}", str(fv.FILLER_WORDS)))
def _(t):
    return matching.ngram_counts(t.documents, "doc_id", "text", 2)


@query("B9_has_any_substring", """
SELECT doc_id, coalesce(contains(lower(text), 'rent') OR contains(lower(text), 'lease') OR contains(lower(text), 'the th'), false) AS hit FROM documents""")
def _(t):
    return t.documents.select("doc_id", text.has_any_substring(F.col("text"), ["rent", "lease", "the th"]).alias("hit"))


@query("B10_first_listed_token_hit", """
WITH d AS (SELECT lower(name) AS low, min(place_id) AS ord FROM gazetteer WHERE NOT contains(name, ' ') GROUP BY 1)
SELECT doc_id, min(ord) AS place_order, arg_min(d.low, ord) AS place FROM doc_tokens t JOIN d ON t.low = d.low GROUP BY 1""")
def _(t):
    listed = t.gazetteer.filter(~F.col("name").contains(" ")).groupBy(F.lower("name").alias("token")).agg(F.min("place_id").alias("ord"))
    return matching.first_listed_token(t.documents, "doc_id", "text", listed, "token", "ord").select("doc_id", F.col("ord").alias("place_order"), F.col("token").alias("place"))


@query("B11_regex_code", r"""
SELECT page_id, CASE x WHEN 1 THEN 'Fort' WHEN 2 THEN 'Slave Island' WHEN 3 THEN 'Kollupitiya' WHEN 4 THEN 'Bambalapitiya' WHEN 5 THEN 'Havelock Town' WHEN 6 THEN 'Wellawatta' WHEN 7 THEN 'Kurunduwatta' WHEN 8 THEN 'Borella'
  WHEN 9 THEN 'Dematagoda' WHEN 10 THEN 'Maradana' WHEN 11 THEN 'Pettah' WHEN 12 THEN 'Aluthkade' WHEN 13 THEN 'Kotahena' WHEN 14 THEN 'Grandpass' WHEN 15 THEN 'Mattakkuliya' END AS place
FROM (SELECT page_id, list_filter(list_transform(regexp_extract_all(url, '/(\d{1,2})(?:[^\d]|$)', 1), lambda v: CAST(v AS INT)), lambda n: n BETWEEN 1 AND 15)[1] AS x FROM pages)""")
def _(t):
    return t.pages.select("page_id", text.regex_code(F.col("url"), r"/(\d{1,2})(?:[^\d]|$)", fv.POSTAL_AREAS).alias("place"))


@query("B11_postal_area", r"""
SELECT c_custkey, CASE c_custkey % 18 WHEN 1 THEN 'Fort' WHEN 2 THEN 'Slave Island' WHEN 3 THEN 'Kollupitiya' WHEN 4 THEN 'Bambalapitiya' WHEN 5 THEN 'Havelock Town' WHEN 6 THEN 'Wellawatta' WHEN 7 THEN 'Kurunduwatta' WHEN 8 THEN 'Borella'
  WHEN 9 THEN 'Dematagoda' WHEN 10 THEN 'Maradana' WHEN 11 THEN 'Pettah' WHEN 12 THEN 'Aluthkade' WHEN 13 THEN 'Kotahena' WHEN 14 THEN 'Grandpass' WHEN 15 THEN 'Mattakkuliya' END AS place FROM customer""")
def _(t):
    address = F.concat(F.col("c_name"), F.lit(", Colombo 0"), (F.col("c_custkey") % 18).cast("string"))
    return t.customer.select("c_custkey", text.regex_code(address, fv.POSTAL_PATTERN, fv.POSTAL_AREAS).alias("place"))


@query("B12_distinctive_tokens", """
WITH d AS (SELECT p_partkey, list_sort(list_filter(list_distinct(regexp_extract_all(lower(p_name || ' of the ' || p_type), '[a-z]+')), lambda w: w NOT IN ('of', 'the', 'small'))) AS w FROM part)
SELECT p_partkey, array_to_string(w, ' ') AS tokens, list_has_any(w, ['ring', 'bolt', 'promo']) AS shares FROM d""")
def _(t):
    tokens = text.distinctive_tokens(F.concat("p_name", F.lit(" of the "), "p_type"), ["of", "the", "small"])
    return t.part.select("p_partkey", F.array_join(tokens, " ").alias("tokens"),
                         F.arrays_overlap(tokens, text.literal_array(["ring", "bolt", "promo"])).alias("shares"))


def b13_sql():
    rev = lambda a: f"instr(reverse(low), '{a[::-1]}')"
    items = ["nm"] + [f"CASE WHEN {rev(a)} > 0 THEN left(nm, length(nm) - {rev(a)} - {len(a) - 1}) || '{b}' || substring(nm, length(nm) - {rev(a)} + 2) END" for a, b in fv.SPELLING_SWAPS]
    return f"""WITH n AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Wela' || p_name WHEN 1 THEN p_name || 'wala th' ELSE p_name || ' Toowela' END AS nm FROM part),
    v AS (SELECT p_partkey, unnest([{', '.join(items)}]) AS v, unnest(range(0, {len(items)})) AS i FROM (SELECT *, lower(nm) AS low FROM n)),
    f AS (SELECT p_partkey, min(i) AS i, arg_min(v, i) AS v FROM v WHERE v IS NOT NULL GROUP BY p_partkey, lower(v))
    SELECT p_partkey, string_agg(v, '|' ORDER BY i) AS variants FROM f GROUP BY 1"""


@query("B13_spelling_variants", b13_sql())
def _(t):
    k = F.col("p_partkey") % 3
    name = F.when(k == 0, F.concat(F.lit("Wela"), "p_name")).when(k == 1, F.concat("p_name", F.lit("wala th"))).otherwise(F.concat("p_name", F.lit(" Toowela")))
    return t.part.select("p_partkey", F.array_join(text.spelling_variants(name), "|").alias("variants"))


@query("B14_name_variants", """
WITH b AS (SELECT s_suppkey, s_suppkey % 4 AS k, 'Alpha' || chr(CAST(97 + s_suppkey % 26 AS INT)) AS w, CASE WHEN s_suppkey % 2 = 0 THEN 'Town' || chr(CAST(97 + s_suppkey % 7 AS INT)) || ', West' ELSE '' END AS loc FROM supplier),
v AS (SELECT s_suppkey, CASE k WHEN 0 THEN ['The ' || w || ' School', w || ' School', 'School The ' || w, CASE WHEN loc <> '' THEN w || ' School ' || string_split(loc, ',')[1] END]
  WHEN 1 THEN ['University of the ' || w, w || ' University', w, CASE WHEN loc <> '' THEN 'University of the ' || w || ' ' || string_split(loc, ',')[1] END]
  WHEN 2 THEN ['Base Hospital ' || w, w || ' Base Hospital', w || ' hospital', CASE WHEN loc <> '' THEN 'Base Hospital ' || w || ' ' || string_split(loc, ',')[1] END]
  ELSE [w, CASE WHEN loc <> '' THEN w || ' ' || string_split(loc, ',')[1] END] END AS v FROM b)
SELECT s_suppkey, array_to_string(list_filter(v, lambda x: x IS NOT NULL), '|') AS variants FROM v""")
def _(t):
    key, code = F.col("s_suppkey"), lambda base, m: F.chr(F.lit(base) + F.col("s_suppkey") % m)
    word = F.concat(F.lit("Alpha"), code(97, 26))
    place = F.when(key % 2 == 0, F.concat(F.lit("Town"), code(97, 7), F.lit(", West"))).otherwise("")
    name = F.when(key % 4 == 0, F.concat(F.lit("The "), word, F.lit(" School"))).when(key % 4 == 1, F.concat(F.lit("University of the "), word)).when(
        key % 4 == 2, F.concat(F.lit("Base Hospital "), word)).otherwise(word)
    return t.supplier.select("s_suppkey", F.array_join(text.name_variants(name, place, ["Base Hospital"]), "|").alias("variants"))


@query("B15_price_derivations", """
SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice / nullif(l_quantity, 0), 8) AS implied, round(ln(l_extendedprice / l_quantity), 6) AS log_price, round(exp(ln(l_extendedprice / l_quantity)), 8) AS price FROM lineitem""")
def _(t):
    implied = numeric.implied_unit_price(F.col("l_extendedprice"), F.col("l_quantity"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", r(implied, 8).alias("implied"), r(F.log(implied)).alias("log_price"), r(F.exp(F.log(implied)), 8).alias("price"))


@query("B16_excel_serial", "SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS INT) END AS serial FROM orders")
def _(t):
    return t.orders.select("o_orderkey", numeric.excel_serial(F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderdate"))).alias("serial"))


@query("B17_label_transforms", """
SELECT land_type, replace(substring('Land_type_' || land_type, 11), '_', ' / ') AS label, CASE WHEN land_type = 'R_F' THEN 'Unknown' ELSE upper(left(land_type, 1)) || lower(substring(land_type, 2)) END AS title, count(*) AS n FROM listings GROUP BY 1""")
def _(t):
    counted = t.listings.groupBy("land_type").agg(F.count("*").alias("n"))
    return counted.select("land_type", text.display_label(F.concat(F.lit("Land_type_"), "land_type"), "Land_type_").alias("label"),
                          text.title_label(F.when(F.col("land_type") != "R_F", F.col("land_type"))).alias("title"), "n")


@query("B18_extract_phrases", r"""
WITH e AS (SELECT unnest(regexp_extract_all(lower(text), '(\d+)[ .\-]([a-z]+)', 2)) AS word, unnest(regexp_extract_all(lower(text), '(\d+)[ .\-]([a-z]+)', 1)) AS num FROM documents),
c AS (SELECT word, count(*) AS n, count(DISTINCT num) AS n_numbers FROM e GROUP BY 1)
SELECT * FROM c ORDER BY n DESC, word LIMIT 25""")
def _(t):
    return matching.common_phrases(t.documents, F.lower("text"), r"(\d+)[ .\-]([a-z]+)", 2, 1, 25).select(F.col("phrase").alias("word"), "n", F.col("n_numbers"))


@query("B19_extract_markers", r"""
WITH e AS (SELECT source, lang, unnest(regexp_extract_all(text, '\d{3,}')) AS m FROM documents)
SELECT source, lang, count(DISTINCT m) AS n_markers, min(m) AS first_marker, max(m) AS last_marker FROM e GROUP BY 1, 2""")
def _(t):
    markers = matching.group_markers(t.documents, ["source", "lang"], "text", r"\d{3,}", 0)
    return markers.groupBy("source", "lang").agg(F.count("*").alias("n_markers"), F.min("marker").alias("first_marker"), F.max("marker").alias("last_marker"))


@query("B20_word_boundary_scope", """
WITH d AS (SELECT DISTINCT lower(name) AS place FROM gazetteer),
g AS (SELECT doc_id, pos, 1 AS n, low AS gram FROM doc_tokens UNION ALL
  SELECT a.doc_id, a.pos, 2, a.low || ' ' || b.low FROM doc_tokens a JOIN doc_tokens b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 UNION ALL
  SELECT a.doc_id, a.pos, 3, a.low || ' ' || b.low || ' ' || c.low FROM doc_tokens a JOIN doc_tokens b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 JOIN doc_tokens c ON a.doc_id = c.doc_id AND c.pos = a.pos + 2)
SELECT doc_id, CAST(arg_min(pos, (pos, -n)) AS INT) AS position, arg_min(gram, (pos, -n)) AS place FROM g JOIN d ON gram = place GROUP BY 1""")
def _(t):
    return matching.first_place_in_scope(t.documents, "doc_id", "text", t.gazetteer.select(F.lower("name").alias("place")).distinct(), "place").select(
        "doc_id", "position", "place")
