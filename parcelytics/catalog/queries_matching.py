"""Joins, dictionary scans, fuzzy matching and the cascade."""

import uuid

from pyspark.sql import functions as F

from parcelytics import fixed_values as fv
from parcelytics.catalog.registry import query
from parcelytics.catalog.registry import rounded as r
from parcelytics.catalog.views import blocks_sql, haversine_sql, sound_sql
from parcelytics.functions import text
from parcelytics.operators import matching as m
from parcelytics.session import ensure_checkpoint_dir


@query("D1_left_lookup", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_brand, p_size FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size > 5")
def _(t):
    dim = t.part.filter("p_size > 5").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size")
    return m.left_lookup(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), dim, "l_partkey")


@query("D2_validated_join", """
WITH c AS (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 3)
SELECT CAST(0 AS BIGINT) AS repeated_right_keys, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM c)) AS left_rows_without_match,
  (SELECT count(*) FROM c WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS unused_right_keys, (SELECT count(*) FROM orders) AS rows_in, (SELECT count(*) FROM orders) AS rows_out""")
def _(t):
    dim = t.customer.filter("c_custkey % 10 <> 3").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return m.validated_join(t.orders.select("o_orderkey", "o_custkey"), dim, "o_custkey")[1]


@query("D2_observed_join", """
WITH c AS (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 3 UNION ALL SELECT c_custkey FROM customer WHERE c_custkey % 10 = 1),
n AS (SELECT c_custkey, count(*) AS n FROM c GROUP BY 1), j AS (SELECT o_custkey, n FROM orders LEFT JOIN n ON o_custkey = c_custkey)
SELECT (SELECT count(*) FROM n WHERE n > 1) AS repeated_right_keys, (SELECT count(*) FROM j WHERE n IS NULL) AS left_rows_without_match,
  (SELECT count(*) FROM n WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS unused_right_keys, (SELECT count(*) FROM orders) AS rows_in,
  (SELECT CAST(sum(coalesce(n, 1)) AS BIGINT) FROM j) AS rows_out""")
def _(t):
    """The counters of the join as it is written, on a right side in which some keys stand twice."""
    once = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name")
    dim = once.filter("o_custkey % 10 <> 3").unionAll(once.filter("o_custkey % 10 = 1"))
    joined, report = m.observed_join(t.orders.select("o_orderkey", "o_custkey"), dim, "o_custkey", unused=True)
    joined.write.parquet(f"{ensure_checkpoint_dir(t.spark)}/observed-{uuid.uuid4().hex}")
    found = report()
    return t.spark.createDataFrame([found], ", ".join(f"{c} long" for c in found))


@query("D3_inner_join_on_index", "SELECT o_orderkey, c_name, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey")
def _(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "inner").select("o_orderkey", "c_name", "c_nationkey")


FULL = """a AS (SELECT l_partkey AS k, avg(l_discount) AS v FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1), b AS (SELECT l_partkey AS k, avg(l_discount) AS v FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1),
j AS (SELECT coalesce(a.k, b.k) AS k, a.v AS a, b.v AS b, abs(a.v - b.v) AS abs_diff, CASE WHEN a.v IS NULL THEN 'only b' WHEN b.v IS NULL THEN 'only a' ELSE 'both' END AS side FROM a FULL JOIN b ON a.k = b.k)"""


def two_tables(t):
    even, odd = (t.lineitem.filter(F.col("l_linenumber") % 2 == p).groupBy(F.col("l_partkey").alias("k")).agg(F.avg("l_discount").alias("v")) for p in (0, 1))
    return m.full_outer_compare(even, odd, "k", "v")


@query("D4_full_outer_compare", f"WITH {FULL} SELECT k, round(a, 6) AS a, round(b, 6) AS b, round(abs_diff, 6) AS abs_diff, side FROM j")
def _(t):
    return two_tables(t).select("k", r("a"), r("b"), r("abs_diff"), "side")


@query("D4_compare_summary", f"WITH {FULL} SELECT count(*) AS n, count(*) FILTER (side = 'both') AS n_both, round(max(abs_diff), 6) AS max_abs_diff, round(corr(a, b), 6) AS r FROM j")
def _(t):
    return m.compare_summary(two_tables(t)).select("n", "n_both", r("max_abs_diff"), r("r"))


@query("D5_semi_anti_reconciliation", "SELECT p_partkey, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.08) AS modelled FROM part")
def _(t):
    known = t.lineitem.filter("l_discount > 0.08").select(F.col("l_partkey").alias("p_partkey"))
    return m.demote_unmatched(t.part.select("p_partkey"), known, "p_partkey")


@query("D6_multi_key_match", """
WITH d AS (SELECT p_partkey, p_name || ' of ' || p_brand AS full_name, CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS base FROM part),
i AS (SELECT base AS k, 0 AS rank, min(p_partkey) AS p FROM d WHERE base IS NOT NULL GROUP BY 1 UNION ALL SELECT full_name, 1, min(p_partkey) FROM d GROUP BY 1),
b AS (SELECT k, min(rank) AS rank, arg_min(p, rank) AS p FROM i GROUP BY 1)
SELECT q.p_partkey AS id, CAST(b.rank AS INT) AS key_rank, b.p AS p_partkey FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' of ' || p_brand ELSE 'none' END AS name FROM part) q LEFT JOIN b ON q.name = b.k""")
def _(t):
    dim = t.part.select("p_partkey", F.concat("p_name", F.lit(" of "), "p_brand").alias("full_name"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")).alias("base"))
    k = F.col("p_partkey") % 3
    asked = t.part.select(F.col("p_partkey").alias("id"), F.when(k == 0, F.col("p_name")).when(k == 1, F.concat("p_name", F.lit(" of "), "p_brand")).otherwise("none").alias("name"))
    return m.multi_key_match(asked, "name", dim, ["base", "full_name"], "p_partkey").select("id", "key_rank", "p_partkey")


@query("D7_claim_collisions", "SELECT l_partkey, count(DISTINCT l_suppkey) AS n_owners FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def _(t):
    return m.claim_collisions(t.lineitem, "l_partkey", "l_suppkey")


def filler_sql(max_n):
    """N-grams of document tokens that are not made of filler words only."""
    parts = []
    for n in range(1, max_n + 1):
        names = [f"t{i}" for i in range(n)]
        joins = " ".join(f"JOIN doc_tokens t{i} ON t0.doc_id = t{i}.doc_id AND t{i}.pos = t0.pos + {i}" for i in range(1, n))
        gram = " || ' ' || ".join(f"{x}.key" for x in names)
        span = " || ' ' || ".join(f"{x}.tok" for x in names)
        filler = " AND ".join(f"{x}.low IN (SELECT f FROM fl)" for x in names)
        parts.append(f"SELECT t0.doc_id, {n} AS n, t0.pos, {gram} AS gram, {span} AS span FROM doc_tokens t0 {joins} WHERE NOT ({filler})")
    return f"fl AS (SELECT unnest({fv.FILLER_WORDS}) AS f), grams AS (" + " UNION ALL ".join(parts) + ")"


@query("D8_alias_match", f"""
WITH {filler_sql(3)}, al AS (SELECT key, min(place_id) AS place_id FROM gazetteer WHERE contains(name, ' ') GROUP BY 1),
h AS (SELECT doc_id, place_id, span, n, pos FROM grams JOIN al ON gram = key)
SELECT doc_id, arg_min('P' || place_id, (-n, pos)) AS division, arg_min(span, (-n, pos)) AS span, CAST(max(n) AS INT) AS n FROM h GROUP BY 1""")
def _(t):
    aliases = t.gazetteer.filter(F.col("name").contains(" ")).groupBy(F.col("key").alias("alias_key")).agg(F.min("place_id").alias("p"))
    named = aliases.select("alias_key", F.concat(F.lit("P"), F.col("p").cast("string")).alias("division"))
    return m.alias_match(t.documents, "doc_id", "text", named, 3)


@query("D8_script_aliases", """
WITH t AS (SELECT p_partkey, p_name || ' ' || lower(p_type) AS body FROM part), w AS (SELECT unnest(string_split(body, ' ')) AS name FROM t),
al AS (SELECT name, 'A ' || name AS division FROM w WHERE length(name) BETWEEN 3 AND 5 GROUP BY 1), nm AS (SELECT name, 'N ' || name AS division FROM w WHERE length(name) >= 6 GROUP BY 1),
h AS (SELECT p_partkey, 0 AS r, al.* FROM t JOIN al ON contains(body, name) UNION ALL SELECT p_partkey, 1, nm.* FROM t JOIN nm ON contains(body, name)),
b AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY r, -length(name), name, division) AS rn FROM h)
SELECT p_partkey, division, name, CASE r WHEN 0 THEN 'alias' ELSE 'script' END AS how FROM b WHERE rn = 1""")
def _(t):
    texts = t.part.select("p_partkey", F.concat_ws(" ", "p_name", F.lower("p_type")).alias("body"))
    words = texts.select(F.explode(F.split("body", " ")).alias("name")).distinct()
    aliases = words.filter(F.length("name").between(3, 5)).withColumn("division", F.concat(F.lit("A "), F.col("name")))
    names = words.filter(F.length("name") >= 6).select("name", F.concat(F.lit("N "), F.col("name")).alias("division"), F.lit(1.0).alias("area"))
    return m.script_match(texts, "p_partkey", "body", names, aliases)


@query("D9_exact_ngram_match", f"""
WITH {filler_sql(3)}, h AS (SELECT doc_id, place_id, area, span, n, pos FROM grams JOIN gazetteer ON gram = key),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, area, pos, place_id, span) AS rn FROM h)
SELECT doc_id, place_id AS division, span, CAST(n AS INT) AS n FROM b WHERE rn = 1""")
def _(t):
    return m.exact_ngram_match(t.documents, "doc_id", "text", t.gazetteer.withColumnRenamed("place_id", "division"), 3)


@query("D10_contains_match", """
SELECT doc_id, arg_min(place_id, (-length(name), area, name, place_id)) AS division, arg_min(name, (-length(name), area, name, place_id)) AS name
FROM documents JOIN gazetteer ON length(name) >= 3 AND contains(text, name) GROUP BY 1""")
def _(t):
    return m.contains_match(t.documents, "doc_id", "text", t.gazetteer.withColumnRenamed("place_id", "division"))


MISSPELT = """q AS (SELECT DISTINCT CASE WHEN p_partkey % 4 = 0 THEN left(n, 2) || substring(n, 4) ELSE n END AS q FROM (SELECT p_partkey, p_name || ' ' || lower(p_type) AS n FROM part)),
p AS (SELECT DISTINCT p_name || ' ' || lower(p_type) AS n FROM part)"""


def misspelt(t):
    full = t.part.select("p_partkey", F.concat_ws(" ", "p_name", F.lower("p_type")).alias("n"))
    wrong = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.left("n", F.lit(2)), F.substring("n", 4, 1000))).otherwise(F.col("n"))
    return full.select(wrong.alias("q")), full.select("n")


@query("D11_fuzzy_match_edit", f"""
WITH {MISSPELT}, s AS (SELECT q, n, 1 - levenshtein(q, n) / CAST(greatest(length(q), length(n)) AS DOUBLE) AS ratio FROM q, p)
SELECT q, max(n ORDER BY ratio, n) AS n, round(max(ratio), 6) AS ratio FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY ratio DESC, n DESC) AS rn FROM s WHERE ratio >= 0.85) WHERE rn = 1 GROUP BY 1""")
def _(t):
    queries, pool = misspelt(t)
    return m.fuzzy_match(queries, "q", pool, "n", 0.85, "edit").select("q", "n", r("ratio"))


@query("D11_near_misses", f"""
WITH {MISSPELT}, w AS (SELECT DISTINCT CASE length(q) % 3 WHEN 0 THEN 'zz' || substring(q, 5) WHEN 1 THEN substring(q, 4) || 'zz' ELSE q END AS q FROM q),
s AS (SELECT w.q, n, 1 - levenshtein(w.q, n) / CAST(greatest(length(w.q), length(n)) AS DOUBLE) AS ratio FROM w, p),
b AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY ratio DESC, n DESC) AS rn FROM s WHERE ratio >= 0.70)
SELECT q, n, round(ratio, 6) AS ratio FROM b WHERE rn = 1 AND ratio < 0.85""")
def _(t):
    queries, pool = misspelt(t)
    k, q = F.length("q") % 3, F.col("q")
    worse = F.when(k == 0, F.concat(F.lit("zz"), F.substring(q, 5, 1000))).when(k == 1, F.concat(F.substring(q, 4, 1000), F.lit("zz"))).otherwise(q)
    return m.near_misses(queries.select(worse.alias("q")), "q", pool, "n", 0.70, 0.85).select("q", "n", r("ratio"))


@query("D11_fuzzy_match_exact_ratio", f"""
WITH RECURSIVE {MISSPELT}, {blocks_sql("SELECT n AS a, q AS b FROM q, p UNION ALL SELECT q, n FROM q, p", 0.90)},
s AS (SELECT b AS q, a AS n, row_number() OVER (PARTITION BY b ORDER BY ratio DESC, a DESC) AS rn FROM mr JOIN p ON a = n JOIN q ON b = q WHERE ratio >= 0.90)
SELECT s.q, s.n, round(ratio, 6) AS ratio FROM s JOIN mr ON a = s.q AND b = s.n WHERE rn = 1""")
def _(t):
    queries, pool = misspelt(t)
    return m.fuzzy_match(queries, "q", pool, "n", 0.90, "matching").select("q", "n", r("ratio"))


POOL = """p AS (SELECT DISTINCT p_brand AS scope, replace(p_name, ' ', '') || CASE p_partkey % 3 WHEN 0 THEN 'north' WHEN 1 THEN '2' ELSE '' END AS n FROM part),
w AS (SELECT DISTINCT CASE WHEN p_partkey % 5 = 0 THEN 'Brand#99' ELSE p_brand END AS scope, CASE WHEN p_partkey % 4 = 0 THEN left(replace(p_name, ' ', ''), 2) || substring(replace(p_name, ' ', ''), 4) ELSE replace(p_name, ' ', '') END AS q,
  CASE WHEN p_partkey % 6 = 0 THEN 'h' ELSE '' END AS suffix FROM part WHERE p_name <> 'red ring'),
x AS (SELECT DISTINCT scope, n, unnest(list_filter(list_transform(range(6, greatest(length(n), 7)), lambda j: CASE WHEN regexp_full_match(substring(n, CAST(j AS INT) + 1), '(north|south|east|west|[a-e]|[0-9])+') THEN left(n, j) END), lambda v: v IS NOT NULL)) AS head FROM p)"""
POOL_STAGES = """a AS (SELECT scope, q, suffix, n AS matched, 1 AS stage FROM f1 WHERE rn = 1 AND (suffix = '' OR ends_with(n, suffix))
  UNION ALL SELECT w.scope, q, suffix, string_agg(DISTINCT n, '|' ORDER BY n), 2 FROM w JOIN x ON w.scope = x.scope AND q = head GROUP BY 1, 2, 3
  UNION ALL SELECT scope, q, suffix, n, 3 FROM f3 WHERE rn = 1 AND (suffix = '' OR ends_with(n, suffix))
  UNION ALL SELECT w.scope, q, suffix, string_agg(DISTINCT n, '|' ORDER BY n), 4 FROM w JOIN x ON q = head GROUP BY 1, 2, 3)
SELECT scope, q, suffix, arg_min(matched, stage) AS matched, CAST(min(stage) AS INT) AS stage FROM a GROUP BY 1, 2, 3"""
LEV_NAMES = "1 - levenshtein(q, n) / CAST(greatest(length(q), length(n)) AS DOUBLE)"


@query("D12_name_pool_match", f"""
WITH {POOL},
f1 AS (SELECT w.*, n, row_number() OVER (PARTITION BY w.scope, q, suffix ORDER BY {LEV_NAMES} DESC, n DESC) AS rn FROM w JOIN p ON w.scope = p.scope WHERE {LEV_NAMES} >= 0.85),
f3 AS (SELECT w.*, n, row_number() OVER (PARTITION BY w.scope, q, suffix ORDER BY {LEV_NAMES} DESC, n DESC) AS rn FROM w JOIN (SELECT DISTINCT n FROM p) pp ON {LEV_NAMES} >= 0.85),
{POOL_STAGES}""")
def _(t):
    return pool_match(t, "edit")


@query("D12_name_pool_match_blocks", f"""
WITH RECURSIVE {POOL}, {blocks_sql("SELECT n AS a, q AS b FROM w, p", 0.85)},
f1 AS (SELECT w.*, n, row_number() OVER (PARTITION BY w.scope, q, suffix ORDER BY ratio DESC, n DESC) AS rn FROM w JOIN p ON w.scope = p.scope JOIN mr ON a = n AND b = q WHERE ratio >= 0.85),
f3 AS (SELECT w.*, n, row_number() OVER (PARTITION BY w.scope, q, suffix ORDER BY ratio DESC, n DESC) AS rn FROM w JOIN mr ON b = q JOIN (SELECT DISTINCT n FROM p) ON a = n WHERE ratio >= 0.85),
{POOL_STAGES}""")
def _(t):
    return pool_match(t, "matching")


def pool_match(t, mode):
    k, plain = F.col("p_partkey"), F.replace(F.col("p_name"), F.lit(" "), F.lit(""))
    pool = t.part.select(F.col("p_brand").alias("scope"), F.concat(plain, F.when(k % 3 == 0, "north").when(k % 3 == 1, "2").otherwise("")).alias("n"))
    wanted = t.part.select(
        F.when(k % 5 == 0, "Brand#99").otherwise(F.col("p_brand")).alias("scope"),
        F.when(k % 4 == 0, F.concat(F.left(plain, F.lit(2)), F.substring(plain, 4, 1000))).otherwise(plain).alias("q"),
        F.when(k % 6 == 0, "h").otherwise("").alias("suffix"), "p_name").filter("p_name <> 'red ring'").drop("p_name")
    return m.name_pool_match(wanted, "q", "scope", pool, "n", "suffix", mode=mode)


SCAN = f"""pl AS (SELECT key, 'D' || min(place_id) AS district FROM gazetteer WHERE NOT contains(name, ' ') GROUP BY 1),
kn AS (SELECT DISTINCT key FROM gazetteer WHERE contains(name, ' ')), fl AS (SELECT unnest({fv.FILLER_WORDS}) AS f),
tk AS (SELECT t.*, lead(low, 1) OVER w AS n1, lead(low, 2) OVER w AS n2 FROM doc_tokens t WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
ok AS (SELECT * FROM tk WHERE low NOT IN (SELECT f FROM fl) AND (n1 IS NULL OR n1 NOT IN (SELECT unnest({fv.ROAD_WORDS}))) AND (n2 IS NULL OR n2 NOT IN (SELECT unnest({fv.ROAD_WORDS})))),
u AS (SELECT DISTINCT key FROM ok WHERE length(key) >= 6 AND key NOT IN (SELECT key FROM pl) AND key NOT IN (SELECT key FROM kn))"""
SCAN_HITS = """d AS (SELECT key, district, 'exact' AS how FROM pl UNION ALL SELECT key, district, 'fuzzy~' || place FROM s WHERE rn = 1),
h AS (SELECT doc_id, pos, district, tok, how, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM ok JOIN d USING (key))
SELECT doc_id, district, tok AS token, how, CAST(pos - 1 AS INT) AS pos FROM h WHERE rn = 1"""


@query("D13_guarded_scan", f"""
WITH {SCAN},
s AS (SELECT u.key, pl.key AS place, district, row_number() OVER (PARTITION BY u.key ORDER BY 1 - levenshtein(u.key, pl.key) / CAST(greatest(length(u.key), length(pl.key)) AS DOUBLE) DESC, pl.key DESC) AS rn
  FROM u JOIN pl ON 1 - levenshtein(u.key, pl.key) / CAST(greatest(length(u.key), length(pl.key)) AS DOUBLE) >= 0.90 - 1e-12),
{SCAN_HITS}""")
def _(t):
    return scan(t, "edit")


@query("D13_guarded_scan_blocks", f"""
WITH RECURSIVE {SCAN}, {blocks_sql("SELECT pl.key AS a, u.key AS b FROM u, pl", 0.90)},
s AS (SELECT b AS key, a AS place, district, row_number() OVER (PARTITION BY b ORDER BY ratio DESC, a DESC) AS rn FROM mr JOIN pl ON pl.key = a WHERE ratio >= 0.90),
{SCAN_HITS}""")
def _(t):
    return scan(t, "matching")


def scan(t, mode):
    places = t.gazetteer.filter(~F.col("name").contains(" ")).groupBy(F.col("key").alias("place_key")).agg(
        F.concat(F.lit("D"), F.min("place_id").cast("string")).alias("district"))
    known = t.gazetteer.filter(F.col("name").contains(" ")).select("key").distinct()
    return m.guarded_scan(t.documents, "doc_id", "text", places, known, mode=mode)


def cascade(t, mode):
    k = F.col("p_partkey")
    wrong = F.concat(F.left("p_name", F.lit(2)), F.substring("p_name", 4, 1000))
    adverts = t.part.select(
        "p_partkey",
        F.when(k % 7 == 0, None).when(k % 7 == 1, F.concat(F.lit("12 "), "p_name", F.lit(" Rd"))).when(k % 7 == 2, "Dr. Silva Mw, Colombo 05")
        .when(k % 7 == 3, F.concat(wrong, F.lit(" junction"))).when(k % 7 == 4, "Kalutara beach side").when(k % 7 == 5, "ගොඩගම පාර").otherwise("nothing known").alias("address"),
        F.when(k % 2 == 0, "Old Town").otherwise(F.col("p_type")).alias("town"), F.col("p_name").alias("title"))
    base = t.part.filter("p_size > 12").groupBy(F.col("p_name").alias("division")).agg((1.0 + F.min("p_partkey") % 9).alias("area"))
    names = base.select("division", text.latin_key(F.col("division")).alias("key"), "area")
    one = t.region.limit(1)
    aliases = one.select(F.lit(text_key("promo")).alias("alias_key"), F.lit("Promo Quarter").alias("division"))
    other = one.select(F.lit(text_key("Kalutara")).alias("place_key"), F.lit("Kalutara").alias("district"))
    outside = one.select(F.lit(text_key("nothing known")).alias("place_key"), F.lit("Gampaha").alias("district"))
    script = one.select(F.lit("ගොඩගම").alias("name"), F.lit("Godagama").alias("division"), F.lit(2.0).alias("area"))
    texts = adverts.select(F.explode(F.array("address", "town", "title")).alias("text"))
    resolved = m.resolve_texts(texts, "text", names, aliases, other, script, outside, mode=mode)
    return m.match_cascade(adverts, ["address", "town", "title"], resolved)


def text_key(name):
    import re

    s = name.lower()
    for old, new in [*fv.ASPIRATES, *fv.VOWELS, ("w", "v")]:
        s = s.replace(old, new)
    return re.sub(r"(.)\1+", r"\1", s)


LEV = "1 - levenshtein({a}, {b}) / CAST(greatest(length({a}), length({b})) AS DOUBLE)"


ADVERTS = f"""ad AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 1 THEN '12 ' || p_name || ' Rd' WHEN 2 THEN 'Dr. Silva Mw, Colombo 05' WHEN 3 THEN left(p_name, 2) || substring(p_name, 4) || ' junction' WHEN 4 THEN 'Kalutara beach side'
    WHEN 5 THEN 'ගොඩගම පාර' WHEN 6 THEN 'nothing known' END AS address, CASE WHEN p_partkey % 2 = 0 THEN 'Old Town' ELSE p_type END AS town, p_name AS title, left(p_name, 2) || substring(p_name, 4) AS wrong, p_type FROM part),
nm AS (SELECT p_name AS division, 1 + min(p_partkey) % 9 AS area FROM part WHERE p_size > 12 GROUP BY 1),
nk AS (SELECT division, area, array_to_string(list_transform(string_split(division, ' '), lambda x: {sound_sql('x')}), ' ') AS key FROM nm),
wr AS (SELECT DISTINCT wrong, array_to_string(list_transform(string_split(wrong, ' '), lambda x: {sound_sql('x')}), ' ') AS gram FROM (SELECT wrong FROM ad UNION SELECT title FROM ad))"""
RESOLVED = f"""mt AS (SELECT ad.*, n.division AS title_div, e.division AS wrong_exact, f.division AS wrong_fuzzy, g.division AS title_fuzzy FROM ad LEFT JOIN nm n ON ad.title = n.division LEFT JOIN nk e ON array_to_string(list_transform(string_split(ad.wrong, ' '), lambda x: {sound_sql('x')}), ' ') = e.key
  LEFT JOIN bg f ON ad.wrong = f.wrong AND f.rn = 1 LEFT JOIN bg g ON ad.title = g.wrong AND g.rn = 1),
r1 AS (SELECT *, CASE WHEN p_partkey % 7 = 4 THEN 'out_of_district' WHEN p_partkey % 7 = 1 AND title_div IS NOT NULL THEN 'exact' WHEN p_partkey % 7 = 1 AND title_fuzzy IS NOT NULL THEN 'fuzzy' WHEN p_partkey % 7 = 2 THEN 'postal' WHEN p_partkey % 7 = 5 THEN 'script'
    WHEN p_partkey % 7 = 3 AND wrong_exact IS NOT NULL THEN 'exact' WHEN p_partkey % 7 = 3 AND wrong_fuzzy IS NOT NULL THEN 'fuzzy' WHEN p_partkey % 7 = 6 THEN 'out_of_district' END AS s1,
  CASE WHEN p_partkey % 2 <> 0 AND p_type = 'PROMO' THEN 'alias' END AS s2, CASE WHEN title_div IS NOT NULL THEN 'exact' WHEN title_fuzzy IS NOT NULL THEN 'fuzzy' END AS s3 FROM mt)
SELECT p_partkey, CASE WHEN s1 = 'out_of_district' THEN NULL WHEN s1 = 'postal' THEN 'Havelock Town' WHEN s1 = 'script' THEN 'Godagama' WHEN s1 = 'exact' AND p_partkey % 7 = 1 THEN title_div WHEN s1 = 'exact' THEN wrong_exact
  WHEN s1 = 'fuzzy' AND p_partkey % 7 = 1 THEN title_fuzzy WHEN s1 = 'fuzzy' THEN wrong_fuzzy WHEN s2 = 'alias' THEN 'Promo Quarter' ELSE coalesce(title_div, title_fuzzy) END AS division,
  coalesce(s1, s2, s3, 'unmatched') AS match_stage, CASE WHEN s1 IS NOT NULL THEN 'address' WHEN s2 IS NOT NULL THEN 'town' WHEN s3 IS NOT NULL THEN 'title' END AS match_field FROM r1"""


@query("D14_match_cascade", f"""
WITH {ADVERTS},
bg AS (SELECT wrong, division, row_number() OVER (PARTITION BY wrong ORDER BY {LEV.format(a='gram', b='key')} DESC, key DESC) AS rn, {LEV.format(a='gram', b='key')} AS ratio FROM wr, nk WHERE {LEV.format(a='gram', b='key')} >= 0.90 - 1e-12),
{RESOLVED}""")
def _(t):
    return cascade(t, "edit").select("p_partkey", "division", "match_stage", "match_field")


@query("D14_match_cascade_blocks", f"""
WITH RECURSIVE {ADVERTS}, {blocks_sql("SELECT key AS a, gram AS b FROM wr, nk UNION ALL SELECT gram, key FROM wr, nk", 0.90)},
bg AS (SELECT wrong, division, row_number() OVER (PARTITION BY wrong ORDER BY mr.ratio DESC, key DESC) AS rn, back.ratio FROM wr JOIN mr ON mr.b = gram JOIN nk ON nk.key = mr.a JOIN mr back ON back.a = gram AND back.b = nk.key WHERE mr.ratio >= 0.90),
{RESOLVED}""")
def _(t):
    return cascade(t, "matching").select("p_partkey", "division", "match_stage", "match_field")


@query("D15_resolve_collision", f"""
WITH a AS (SELECT point_id, nation, CASE WHEN point_id % 5 <> 0 THEN lat END AS lat, CASE WHEN point_id % 5 <> 0 THEN lon END AS lon FROM points),
c AS (SELECT nation, unit_id, lat AS c_lat, lon AS c_lon, count(*) OVER (PARTITION BY nation) AS n FROM units),
j AS (SELECT point_id, a.lat, c.n, c.unit_id, row_number() OVER (PARTITION BY point_id ORDER BY {haversine_sql('a.lat', 'a.lon', 'c_lat', 'c_lon', 6371.0)} NULLS FIRST, unit_id) AS rn FROM a LEFT JOIN c ON a.nation = c.nation)
SELECT point_id, CASE WHEN NOT coalesce(n > 1 AND lat IS NULL, false) THEN unit_id END AS unit_id, coalesce(n > 1 AND lat IS NULL, false) AS ambiguous FROM j WHERE rn = 1""")
def _(t):
    known = F.col("point_id") % 5 != 0
    rows = t.points.select("point_id", "nation", F.when(known, F.col("lat")).alias("lat"), F.when(known, F.col("lon")).alias("lon"))
    candidates = t.units.select("nation", "unit_id", F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"))
    return m.resolve_collision(rows, "nation", "lat", "lon", candidates, "unit_id").select("point_id", "unit_id", "ambiguous")


@query("D32_list_crosscheck", """
WITH l AS (SELECT DISTINCT string_split(p_name, ' ')[2] AS w FROM part WHERE p_size = 7),
v AS (SELECT p_partkey, any_value(p) AS p, bool_or(w IN (SELECT w FROM l)) AS l FROM (SELECT p_partkey, p_retailprice > 950 AS p, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1)
SELECT count(*) FILTER (p AND l) AS tp, count(*) FILTER (NOT p AND l) AS fn, count(*) FILTER (p AND NOT l) AS fp, count(*) FILTER (NOT p AND NOT l) AS tn FROM v""")
def _(t):
    listed = t.part.filter("p_size = 7").select(F.split("p_name", " ")[1].alias("w"))
    return m.list_crosscheck(t.part, "p_partkey", F.split("p_name", " "), F.col("p_retailprice") > 950, listed, "w")
