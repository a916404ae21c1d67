"""Lookups, dictionary scans over text, fuzzy joins and the match cascade.

Texts are compared with dictionaries through equi-joins on n-grams or on string segments; nothing is compared with
everything. A text that occurs many times is matched once and the result is joined back.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from parcelytics import fixed_values as fv
from parcelytics.functions import blocks, geo, text
from parcelytics.plans.scale import keep_first, maybe_broadcast, null_safe_join, spread
from parcelytics.plans.spatial import nearest
from parcelytics.session import freeze

OUT_OF_DISTRICT = "__OUT_OF_DISTRICT__"


# --------------------------------------------------------------------------- equi-joins and key sets
def left_lookup(fact: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Many-to-one left join."""
    return fact.join(maybe_broadcast(dim), key, "left")


def validated_join(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(joined, report): a many-to-one left join plus the checks on it.

    The report counts repeated right keys, left rows without a match and right keys never used.
    """
    joined = left.join(right, key, "left")
    keys = (
        left.groupBy(key).agg(F.count("*").alias("l"), F.lit(0).cast("long").alias("r"))
        .unionByName(right.groupBy(key).agg(F.lit(0).cast("long").alias("l"), F.count("*").alias("r")))
        .groupBy(key).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    )
    report = keys.agg(
        F.count_if(F.col("r") > 1).alias("repeated_right_keys"),
        F.sum(F.when(F.col("r") == 0, F.col("l")).otherwise(0)).alias("left_rows_without_match"),
        F.count_if((F.col("r") > 0) & (F.col("l") == 0)).alias("unused_right_keys"),
        F.sum("l").alias("rows_in"),
        F.sum(F.col("l") * F.greatest(F.col("r"), F.lit(1))).alias("rows_out"),
    )
    return joined, report


def observed_join(left: DataFrame, right: DataFrame, key: str, unused: bool = False) -> tuple[DataFrame, Callable[[], dict[str, int]]]:
    """(joined, report): a many-to-one left join that counts its invariants while it runs; neither side is read again.

    `report()` waits for the first action on the joined rows. It holds what `validated_join` counts, right keys that no left row
    uses only with `unused`: they need an outer join, which cannot broadcast a small right side. Null keys match nothing.
    Right rows of a key are numbered, which reads the right side sorted by key and holds none of them.
    """
    named = right.withColumnRenamed(key, "__key")
    order = Window.partitionBy("__key").orderBy("__key")
    dim_seen, seen = Observation(), Observation()
    dim = named.withColumn("__copy", F.row_number().over(order)).observe(
        dim_seen, F.count_if((F.col("__copy") == 2) & F.col("__key").isNotNull()).alias("repeated_right_keys"))
    rows = left.withColumn("__left", F.lit(True)).join(dim, F.col(key) == F.col("__key"), "full_outer" if unused else "left")
    ours, first = F.col("__left").isNotNull(), F.coalesce(F.col("__copy"), F.lit(1)) == 1
    counts = {"left_rows_without_match": ours & F.col("__copy").isNull(), "rows_in": ours & first, "rows_out": ours}
    if unused:
        counts["unused_right_keys"] = F.col("__left").isNull() & first
    watched = rows.observe(seen, *[F.count_if(c).alias(name) for name, c in counts.items()])
    joined = watched.filter(ours).select(*left.columns, *[c for c in right.columns if c != key])
    return joined, lambda: {**dim_seen.get, **seen.get}


def full_outer_compare(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Reconcile two result tables: key, both values, absolute difference, presence."""
    left, right = a.select(key, F.col(value).alias("a")), b.select(key, F.col(value).alias("b"))
    side = F.when(F.col("a").isNull(), "only b").when(F.col("b").isNull(), "only a").otherwise("both")
    return left.join(right, key, "full_outer").withColumn("abs_diff", F.abs(F.col("a") - F.col("b"))).withColumn("side", side)


def compare_summary(compared: DataFrame) -> DataFrame:
    """Agreement of two tables joined by `full_outer_compare`: rows, largest difference, correlation."""
    from parcelytics.operators.aggregates import correlation

    return compared.agg(
        F.count("*").alias("n"), F.count_if(F.col("side") == "both").alias("n_both"),
        F.max("abs_diff").alias("max_abs_diff"), correlation(F.col("a"), F.col("b")).alias("r"),
    )


def demote_unmatched(units: DataFrame, known: DataFrame, key: str, flag: str = "modelled") -> DataFrame:
    """Flag units whose key is known; the others stay in the table, demoted."""
    return units.join(known.select(key).distinct().withColumn(flag, F.lit(True)), key, "left").na.fill(False, [flag])


def multi_key_match(df: DataFrame, name: str, dim: DataFrame, keys: Sequence[str], result: str) -> DataFrame:
    """Match a name on several dimension keys in order of preference (base name before full name)."""
    options = F.array(*[F.struct(F.lit(i).alias("__rank"), F.col(k).alias("__key")) for i, k in enumerate(keys)])
    index = dim.select(F.explode(options).alias("o"), result).select("o.*", result).filter("__key IS NOT NULL")
    best = keep_first(index.select("__key", "__rank", result), ["__key"], [F.col("__rank"), F.col(result)])
    return df.join(maybe_broadcast(best), F.col(name) == F.col("__key"), "left").drop("__key").withColumnRenamed("__rank", "key_rank")


def claim_collisions(members: DataFrame, key: str, owner: str) -> DataFrame:
    """Keys claimed by more than one owner."""
    return members.groupBy(key).agg(F.count_distinct(owner).alias("n_owners")).filter("n_owners > 1")


def list_crosscheck(units: DataFrame, unit: str, members: Column, predicted: Column, listed: DataFrame, name: str) -> DataFrame:
    """Confusion counts of a predicted flag against a list of names; a unit counts as listed if any member is."""
    exploded = units.select(unit, predicted.alias("__p"), F.explode(members).alias("__m"))
    names = listed.select(F.col(name).alias("__m"), F.lit(1).alias("__l")).distinct()
    flagged = exploded.join(maybe_broadcast(names), "__m", "left").groupBy(unit).agg(
        F.max(F.col("__p").cast("int")).alias("p"), F.coalesce(F.max("__l"), F.lit(0)).alias("l")
    )
    count = lambda p, l: F.count_if((F.col("p") == p) & (F.col("l") == l))
    return flagged.agg(count(1, 1).alias("tp"), count(0, 1).alias("fn"), count(1, 0).alias("fp"), count(0, 0).alias("tn"))


# --------------------------------------------------------------------------- dictionary scans
def gram_table(texts: DataFrame, columns: Sequence[str], body: str, max_n: int = fv.MAX_NGRAM,
               filler: Sequence[str] = fv.FILLER_WORDS, dictionary: DataFrame | None = None, whole: Column | None = None) -> DataFrame:
    """N-grams of Latin tokens: n, pos (1-based), gram (sound keys), span (as written), any_filler.

    Grams made only of filler words are left out. `columns` identify the text and are carried along. With a
    `dictionary` (column gram) only grams that start with the first word of an entry are built, so most positions
    are dropped by one join on a single key. A text of 1 to `whole` tokens is a gram as a whole, too, fillers or not: n and pos 0,
    its span the text.
    """
    prepared = spread(texts.select(*columns, body)).select(*columns, text.latin_tokens(F.col(body)).alias("__w"), *([body] if whole is not None else []))
    if whole is not None:  # neither is kept of longer texts, so that their windows do not carry the text along
        short = F.size("__w") <= whole
        prepared = prepared.select(*columns, "__w", F.when(short, F.col(body)).alias("__text"), F.when(short, F.col("__w")).alias("__all"))
    carried = [*columns, *(["__text", "__all"] if whole is not None else [])]
    windows = prepared.select(*carried, F.posexplode(text.shifted(F.col("__w"), max_n)).alias("__i", "__s")).select(
        *carried, (F.col("__i") + 1).alias("pos"), *[F.col("__s")[f"w{i}"].alias(f"__w{i}") for i in range(max_n)])
    windows = windows.withColumn("__k0", text.sound_key(F.col("__w0")))
    if dictionary is not None:
        heads = dictionary.select(F.split("gram", " ")[0].alias("__k0")).distinct()
        windows = windows.join(maybe_broadcast(heads), "__k0", "left_semi")
    for i in range(max_n):
        if i:
            windows = windows.withColumn(f"__k{i}", text.sound_key(F.col(f"__w{i}")))
        windows = windows.withColumn(f"__f{i}", F.lower(f"__w{i}").isin(list(filler)))

    def gram(n: int) -> Column:
        some, every = F.col("__f0"), F.col("__f0")
        for i in range(1, n):
            some, every = some | F.col(f"__f{i}"), every & F.col(f"__f{i}")
        return F.when(F.col(f"__w{n - 1}").isNotNull() & ~every, F.struct(
            F.lit(n).alias("n"), F.col("pos").alias("pos"), F.concat_ws(" ", *[f"__k{i}" for i in range(n)]).alias("gram"),
            F.concat_ws(" ", *[f"__w{i}" for i in range(n)]).alias("span"), some.alias("any_filler")))

    grams = [gram(n) for n in range(1, max_n + 1)]
    if whole is not None:
        grams.append(F.when((F.col("pos") == 1) & F.col("__all").isNotNull(), F.struct(
            F.lit(0).alias("n"), F.lit(0).alias("pos"), F.array_join(F.transform("__all", text.sound_key), " ").alias("gram"),
            F.col("__text").alias("span"), F.lit(False).alias("any_filler"))))
    return windows.select(*columns, F.explode(F.array_compact(F.array(*grams))).alias("g")).select(*columns, "g.n", "g.pos", "g.gram", "g.span", "g.any_filler")


def ngram_counts(texts: DataFrame, key: str, body: str, n: int, filler: Sequence[str] = fv.FILLER_WORDS) -> DataFrame:
    """How often each n-gram of Latin tokens occurs per text, grams made only of filler words left out.

    The grams of a key that one row holds are counted in that row; only those of keys with several rows are shuffled.
    """
    rows = texts.select(key, body)
    repeated = freeze(rows.groupBy(key).agg(F.count("*").alias("__rows")).filter("__rows > 1").select(key, F.lit(True).alias("__again")))
    if repeated.isEmpty():
        return _row_grams(rows, key, body, n, filler)
    marked = null_safe_join(rows, maybe_broadcast(repeated), [key], "left")
    once = _row_grams(marked.filter("__again IS NULL").select(key, body), key, body, n, filler)
    again = _row_grams(marked.filter("__again").select(key, body), key, body, n, filler)
    return once.unionByName(again.groupBy(key, "gram").agg(F.sum("n").alias("n")))


def _row_grams(texts: DataFrame, key: str, body: str, n: int, filler: Sequence[str]) -> DataFrame:
    """key, gram, n: the different grams of every row and how often they occur in it."""
    def plain(s: Column) -> Column:
        out = F.lit(True)
        for i in range(n):
            out = out & F.lower(s[f"w{i}"]).isin(list(filler))
        return out

    def runs(grams: Column) -> Column:
        """The sorted grams as structs (gram, n), from the places where a run of equal ones ends."""
        places = F.sequence(F.lit(1), F.greatest(F.size(grams), F.lit(1)))
        ends = F.filter(places, lambda i: (i == F.size(grams)) | (F.get(grams, i - 1) != F.get(grams, i)))
        return text.let(ends, lambda e: F.transform(e, lambda end, j: F.struct(
            F.get(grams, end - 1).alias("gram"), (end - F.coalesce(F.get(e, j - 1), F.lit(0))).cast("long").alias("n"))))

    words = spread(texts).select(key, text.latin_tokens(F.col(body)).alias("__w"))
    kept = F.filter(text.shifted(F.col("__w"), n), lambda s: s[f"w{n - 1}"].isNotNull() & ~plain(s))
    grams = words.select(key, F.transform(kept, lambda s: F.concat_ws(" ", *[s[f"w{i}"] for i in range(n)])).alias("__g"))
    return grams.select(key, F.explode(text.let(F.sort_array("__g"), runs)).alias("c")).select(key, "c.gram", "c.n")


def first_listed_token(texts: DataFrame, key: str, body: str, listed: DataFrame, token: str, order: str) -> DataFrame:
    """The first dictionary entry (dictionary order) that occurs as a whole lower-cased token of the text."""
    words = texts.select(key, F.explode(F.array_distinct(F.transform(text.tokenize(F.col(body)), F.lower))).alias(token))
    hits = words.join(maybe_broadcast(listed.select(token, order)), token)
    return hits.groupBy(key).agg(F.min(F.struct(order, token)).alias("b")).select(key, f"b.{order}", f"b.{token}")


def first_place_in_scope(texts: DataFrame, key: str, body: str, places: DataFrame, place: str, max_n: int = 3) -> DataFrame:
    """The first in-scope place named in the text; at the same position the longer name wins."""
    words = spread(texts.select(key, body)).select(key, text.latin_tokens(F.lower(F.col(body))).alias("__w"))
    windows = words.select(key, F.posexplode(text.shifted(F.col("__w"), max_n)).alias("__i", "__s")).select(
        key, (F.col("__i") + 1).alias("position"), *[F.col("__s")[f"w{i}"].alias(f"__w{i}") for i in range(max_n)])
    heads = places.select(F.split(place, " ")[0].alias("__w0")).distinct()
    windows = windows.join(maybe_broadcast(heads), "__w0", "left_semi")
    named = F.array_compact(F.array(*[
        F.when(F.col(f"__w{n - 1}").isNotNull(), F.struct(F.lit(-n).alias("neg"), F.concat_ws(" ", *[f"__w{i}" for i in range(n)]).alias(place)))
        for n in range(1, max_n + 1)]))
    grams = windows.select(key, "position", F.explode(named).alias("g")).select(key, "position", "g.*")
    hits = grams.join(maybe_broadcast(places.select(place)), place)
    return hits.groupBy(key).agg(F.min(F.struct("position", "neg", place)).alias("b")).select(key, "b.position", f"b.{place}")


def common_phrases(texts: DataFrame, body: Column, pattern: str, phrase_group: int, number_group: int, k: int) -> DataFrame:
    """Most common captured phrases, with how many different numbers they came with."""
    found = texts.select(F.explode(F.arrays_zip(
        F.regexp_extract_all(body, F.lit(pattern), F.lit(phrase_group)).alias("phrase"),
        F.regexp_extract_all(body, F.lit(pattern), F.lit(number_group)).alias("number"))).alias("m"))
    counts = found.select("m.phrase", "m.number").groupBy("phrase").agg(
        F.count("*").alias("n"), F.count_distinct("number").alias("n_numbers"))
    return counts.orderBy(F.col("n").desc(), F.col("phrase")).limit(k)


def group_markers(texts: DataFrame, keys: Sequence[str], body: str, pattern: str, group: int = 0) -> DataFrame:
    """Distinct captured markers per group, one row each (a group's set is never held in one cell)."""
    marks = F.array_distinct(F.regexp_extract_all(F.col(body), F.lit(pattern), F.lit(group)))
    return texts.select(*keys, F.explode(marks).alias("marker")).distinct()


def alias_match(texts: DataFrame, key: str, body: str, aliases: DataFrame, max_n: int = fv.MAX_NGRAM) -> DataFrame:
    """Whole-text alias first, then the longest alias n-gram, leftmost. `aliases`: alias_key, division.

    Returns key, division, span, n (0 for a whole-text hit).
    """
    table = maybe_broadcast(aliases.select(F.col("alias_key").alias("gram"), "division"))
    longest = aliases.agg(F.max(F.size(F.split("alias_key", " "))).alias("m")).scalar()
    grams = gram_table(texts, [key], body, max_n, dictionary=table, whole=longest).join(table, "gram")
    rank = F.when(F.col("n") == 0, -1_000_000).otherwise(-F.col("n"))
    order = F.struct(rank.alias("a"), F.col("pos").alias("b"), "division", "span")
    best = grams.groupBy(key).agg(F.min(F.struct(order.alias("o"), "n")).alias("m"))
    return best.select(key, "m.o.division", "m.o.span", "m.n")


def exact_ngram_match(texts: DataFrame, key: str, body: str, names: DataFrame, max_n: int = fv.MAX_NGRAM) -> DataFrame:
    """Longest n with any hit, then the smallest area, then the leftmost. `names`: key, division, area."""
    table = maybe_broadcast(names.select(F.col("key").alias("gram"), "division", "area"))
    hits = gram_table(texts, [key], body, max_n, dictionary=table).join(table, "gram")
    order = F.struct((-F.col("n")).alias("n"), "area", "pos", "division", "span")
    return hits.groupBy(key).agg(F.min(order).alias("b")).select(key, "b.division", "b.span", (-F.col("b.n")).alias("n"))


def contains_match(texts: DataFrame, key: str, body: str, names: DataFrame) -> DataFrame:
    """The longest dictionary name contained in the text, ties by area then name. `names`: name, division, area.

    Names are looked up by their first six (or three) bytes among the distinct byte windows of the text, as numbers, then
    verified in full; shorter names than three characters are not offered.
    """
    head = F.substring(F.encode("name", "UTF-8"), 1, F.when(F.octet_length("name") >= 6, 6).otherwise(3))
    offered = names.filter(F.length("name") >= 3).withColumn("__head", F.conv(F.hex(head), 16, 10).cast("long"))
    heads = maybe_broadcast(offered.select("__head").distinct())
    rows = spread(texts.select(F.col(key).alias("__key"), F.col(body).cast("string").alias("__text")).filter("__key IS NOT NULL AND __text IS NOT NULL"))
    windows = rows.mapInArrow(blocks.byte_windows, rows.select("__key", F.lit(0).cast("long").alias("__head")).schema)
    seen = windows.join(heads, "__head", "left_semi")
    pairs = seen.join(maybe_broadcast(offered), "__head").select(F.col("__key").alias(key), "name", "division", "area")
    verified = texts.select(key, F.col(body).alias("__t")).join(pairs, key).filter(F.contains("__t", "name"))
    best = verified.groupBy(key).agg(F.min(F.struct((-F.length("name")).alias("l"), "area", "name", "division")).alias("b"))
    return best.select(key, "b.division", "b.name")


def script_match(texts: DataFrame, key: str, body: str, names: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Names in a non-Latin script, found as substrings: an alias goes before every official name.

    `names`: name, division, area; `aliases`: name, division. Returns key, division, name, how ('alias' or 'script').
    """
    official = contains_match(texts, key, body, names).select(key, F.lit(1).alias("__r"), "division", "name", F.lit("script").alias("how"))
    if aliases is None:
        return official.drop("__r")
    known = contains_match(texts, key, body, aliases.withColumn("area", F.lit(0.0)))
    known = known.select(key, F.lit(0).alias("__r"), "division", "name", F.lit("alias").alias("how"))
    return keep_first(known.unionByName(official), [key], [F.col("__r")]).drop("__r")


# --------------------------------------------------------------------------- fuzzy joins
def _max_edits(length: Column, cutoff: float, mode: str) -> Column:
    share = (1 - cutoff) / cutoff * (1 if mode == "edit" else 2)
    return F.floor(length * share + 1e-9).cast("int")


def _length_band(length: Column, cutoff: float, mode: str) -> tuple[Column, Column]:
    ratio = cutoff if mode == "edit" else cutoff / (2 - cutoff)
    return F.ceil(length * ratio - 1e-9).cast("int"), F.floor(length / ratio + 1e-9).cast("int")


def segment_candidates(queries: DataFrame, query: str, pool: DataFrame, name: str, cutoff: float, mode: str = "edit",
                       within: Sequence[str] = ()) -> DataFrame:
    """Pairs that can reach the cutoff, found without comparing everything.

    A pool name of length L that differs by at most k edits is cut in k+1 segments; one of them must occur unchanged
    in the query, moved by at most k places. Pairs are joined on (L, segment number, segment text, `within` columns);
    no pair at or above the cutoff is lost. `mode` is 'edit' (edit ratio) or 'matching' (2M / total length).
    """
    if cutoff < 0.7:
        raise ValueError("segment blocking needs a cutoff of at least 0.7")
    length = F.length(name)
    pieces = F.transform(
        F.sequence(F.lit(0), F.col("__e")),
        lambda i: F.struct(
            F.col("__l").alias("l"), i.alias("i"),
            F.substring(F.col(name), F.floor(i * F.col("__l") / (F.col("__e") + 1)).cast("int") + 1,
                        (F.floor((i + 1) * F.col("__l") / (F.col("__e") + 1)) - F.floor(i * F.col("__l") / (F.col("__e") + 1))).cast("int")).alias("s"),
        ),
    )
    pool_side = pool.select(*within, name).distinct().filter(length > 0).withColumn("__l", length).withColumn(
        "__e", _max_edits(length, cutoff, mode)).select(*within, name, F.explode(pieces).alias("__k"))
    q = F.col(query)
    low, high = _length_band(F.length(q), cutoff, mode)

    def windows(l: Column) -> Column:
        e = _max_edits(l, cutoff, mode)

        def at_segment(i: Column) -> Column:
            start = F.floor(i * l / (e + 1)).cast("int")
            width = F.floor((i + 1) * l / (e + 1)).cast("int") - start
            first, last = F.greatest(start - e, F.lit(0)), F.least(start + e, F.length(q) - width)
            return F.when(last >= first, F.transform(
                F.sequence(first, last), lambda p: F.struct(l.alias("l"), i.alias("i"), F.substring(q, p + 1, width).alias("s"))
            )).otherwise(F.array().cast("array<struct<l:int,i:int,s:string>>"))

        return F.flatten(F.transform(F.sequence(F.lit(0), e), at_segment))

    keys = F.array_distinct(F.flatten(F.transform(F.sequence(F.greatest(low, F.lit(1)), high), windows)))
    query_side = queries.select(*within, query).distinct().filter(F.length(q) > 0).select(*within, query, F.explode(keys).alias("__k"))
    return query_side.join(pool_side, [*within, "__k"]).select(*within, query, name).distinct()


def fuzzy_match(queries: DataFrame, query: str, pool: DataFrame, name: str, cutoff: float = fv.FUZZY_CUTOFF, mode: str = "edit",
                within: Sequence[str] = ()) -> DataFrame:
    """Best pool name per distinct query: query, name, ratio. Ties go to the name that sorts last."""
    pairs = segment_candidates(queries, query, pool, name, cutoff, mode, within)
    score = text.edit_ratio(F.col(query), F.col(name)) if mode == "edit" else blocks.matching_ratio(F.col(name), F.col(query), cutoff)
    reported = F.col("__r") if mode == "edit" else blocks.matching_ratio(F.col(query), F.col("b.name"))
    scored = pairs.withColumn("__r", score).filter(F.col("__r") >= cutoff)
    best = scored.groupBy(*within, query).agg(F.max(F.struct("__r", F.col(name).alias("name"))).alias("b"))
    return best.select(*within, query, F.col("b.name").alias(name), (F.col("b.__r") if mode == "edit" else reported).alias("ratio"))


def near_misses(texts: DataFrame, query: str, pool: DataFrame, name: str, low: float = 0.70, cutoff: float = fv.FUZZY_CUTOFF, mode: str = "edit") -> DataFrame:
    """Audit of unmatched texts: the best name of each distinct text whose ratio reaches `low` but not the cutoff."""
    return fuzzy_match(texts.select(query).distinct(), query, pool, name, low, mode).filter(F.col("ratio") < cutoff)


def fuzzy_ngram_match(texts: DataFrame, key: str, body: str, names: DataFrame, cutoff: float = fv.FUZZY_CUTOFF, mode: str = "edit",
                      max_n: int = fv.MAX_NGRAM, min_length: int = 5) -> DataFrame:
    """Longest n with a name at or above the cutoff, then best ratio, largest area last. `names`: key, division, area.

    Grams with any filler token or fewer than `min_length` characters are not trusted.
    """
    grams = gram_table(texts, [key], body, max_n).filter(~F.col("any_filler") & (F.length("gram") >= min_length))
    matched = fuzzy_match(grams.select("gram"), "gram", names.select("key"), "key", cutoff, mode)
    hits = grams.select(key, "n", "gram", "span").distinct().join(matched, "gram").join(names.select("key", "division", "area"), "key")
    order = F.struct("n", "ratio", (-F.col("area")).alias("a"), "division", "span")
    best = hits.groupBy(key).agg(F.max(order).alias("b"))
    return best.select(key, "b.division", F.concat_ws(" ~ ", "b.span", "b.division").alias("span"), "b.n", "b.ratio")


def name_pool_match(queries: DataFrame, query: str, scope: str, pool: DataFrame, name: str, suffix: str,
                    deny: Sequence[str] = (), cutoff: float = fv.POOL_CUTOFF, mode: str = "edit") -> DataFrame:
    """Match inside the query's own scope, then district-wide; each time fuzzy first, then name + direction or number.

    The best fuzzy name must end in the query's own suffix (when it has one). Returns scope, query, suffix, matched,
    stage: 1 scoped fuzzy, 2 scoped prefix, 3 wide fuzzy, 4 wide prefix.
    """
    wanted = queries.select(scope, query, suffix).distinct().filter(~F.col(query).isin(list(deny)) if deny else F.lit(True))
    tail = r"^(north|south|east|west|[a-e]|\d)+$"
    cuts = F.filter(
        F.transform(F.sequence(F.lit(6), F.greatest(F.length(name) - 1, F.lit(6))), lambda j: F.struct(
            F.left(F.col(name), j).alias("head"), F.substr(F.col(name), j + 1).alias("rest"))),
        lambda c: c["rest"].rlike(tail),
    )
    heads = pool.select(scope, name).distinct().select(scope, name, F.explode(cuts).alias("c")).select(scope, name, F.col("c.head").alias(query))
    fits = (F.col(suffix) == "") | F.endswith("matched", F.col(suffix))

    def fuzzy(within: list[str], stage: int) -> DataFrame:
        found = fuzzy_match(wanted, query, pool, name, cutoff, mode, within).withColumnRenamed(name, "matched")
        return wanted.join(found, [*within, query]).filter(fits).select(scope, query, suffix, "matched", F.lit(stage).alias("stage"))

    def prefixed(within: list[str], stage: int) -> DataFrame:
        joined = wanted.join(heads.select(*within, query, name).distinct(), [*within, query])
        return joined.groupBy(scope, query, suffix).agg(
            F.array_join(F.array_sort(F.collect_set(name)), "|").alias("matched")).withColumn("stage", F.lit(stage))

    every = fuzzy([scope], 1).unionByName(prefixed([scope], 2)).unionByName(fuzzy([], 3)).unionByName(prefixed([], 4))
    return keep_first(every, [scope, query, suffix], [F.col("stage")])


def guarded_scan(texts: DataFrame, key: str, body: str, places: DataFrame, known: DataFrame, cutoff: float = fv.FUZZY_CUTOFF,
                 mode: str = "edit", filler: Sequence[str] = fv.FILLER_WORDS, road: Sequence[str] = fv.ROAD_WORDS) -> DataFrame:
    """First token naming another district's town, unless a road word follows within two tokens.

    An exact sound key beats a fuzzy one; a fuzzy one needs six characters and must not be a known division's key.
    `places`: place_key, district. `known`: key. Returns key, district, token, how, pos.
    """
    words = spread(texts.select(key, body)).select(key, text.latin_tokens(F.col(body)).alias("__w"))
    windows = words.select(key, F.posexplode(text.shifted(F.col("__w"), 3)).alias("pos", "t")).select(key, "pos", "t.*")
    is_road = lambda c: F.coalesce(F.lower(c).isin(list(road)), F.lit(False))
    tokens = windows.filter(~is_road("w1") & ~is_road("w2") & ~F.lower("w0").isin(list(filler))).select(key, "pos", F.col("w0").alias("token"))
    # sound keys and the fuzzy join see every different token once; its few hits are known by size before they meet the texts
    forms = freeze(tokens.select("token").distinct().withColumn("k", text.sound_key(F.col("token"))))
    exact = places.select(F.col("place_key").alias("k"), "district", F.lit("exact").alias("how"))
    unknown = forms.select("k").distinct().filter(F.length("k") >= 6).join(places.select(F.col("place_key").alias("k")), "k", "left_anti").join(
        known.select(F.col("key").alias("k")), "k", "left_anti")
    close = fuzzy_match(unknown, "k", places.select("place_key"), "place_key", cutoff, mode).join(places, "place_key").select(
        "k", "district", F.concat(F.lit("fuzzy~"), "place_key").alias("how"))
    named = freeze(forms.join(exact.unionByName(close), "k").drop("k"))
    hits = tokens.join(maybe_broadcast(named), "token")
    best = hits.groupBy(key).agg(F.min(F.struct("pos", "district", "token", "how")).alias("b"))
    return best.select(key, "b.district", "b.token", "b.how", "b.pos")


# --------------------------------------------------------------------------- the cascade
def resolve_texts(texts: DataFrame, body: str, names: DataFrame, aliases: DataFrame, other_places: DataFrame, script_names: DataFrame,
                  geocoded_out: DataFrame, codes: dict[int, str] = fv.POSTAL_AREAS, code_pattern: str = fv.POSTAL_PATTERN,
                  cutoff: float = fv.FUZZY_CUTOFF, mode: str = "edit", script_aliases: DataFrame | None = None) -> DataFrame:
    """Stage results for distinct texts: text, division, stage, matched. Each text is resolved once.

    Order: other-district town, alias, script alias, script name, exact name, postal area, fuzzy name, geocoded outside place.
    A stage only looks at texts that no cheaper stage resolved, so the fuzzy join sees the remainder.
    """
    distinct = freeze(texts.select(F.col(body).alias("text")).filter("text IS NOT NULL AND trim(text) <> ''").distinct())
    out = F.lit(OUT_OF_DISTRICT).alias("division")
    note = F.concat(F.col("district"), F.lit(" ["), F.col("token"), F.lit("/"), F.col("how"), F.lit("]"))
    scan = guarded_scan(distinct, "text", "text", other_places, names, cutoff, mode).select(
        "text", F.lit(1).alias("rank"), out, F.lit("out_of_district").alias("stage"), note.alias("matched"))
    alias = alias_match(distinct, "text", "text", aliases).select(
        "text", F.lit(2).alias("rank"), "division", F.lit("alias").alias("stage"), F.col("span").alias("matched"))
    script = script_match(distinct, "text", "text", script_names, script_aliases).select(
        "text", F.lit(3).alias("rank"), "division", F.col("how").alias("stage"), F.col("name").alias("matched"))
    exact = exact_ngram_match(distinct, "text", "text", names).select(
        "text", F.lit(4).alias("rank"), "division", F.lit("exact").alias("stage"), F.col("span").alias("matched"))
    postal = distinct.select("text", F.lit(5).alias("rank"), text.regex_code(F.col("text"), code_pattern, codes).alias("division"),
                             F.lit("postal").alias("stage"), F.col("text").alias("matched")).filter("division IS NOT NULL")
    cheap = scan.unionByName(alias).unionByName(script).unionByName(exact).unionByName(postal)
    first = freeze(keep_first(cheap, ["text"], [F.col("rank")]))
    rest = distinct.join(first.select("text"), "text", "left_anti")
    fuzzy = fuzzy_ngram_match(rest, "text", "text", names, cutoff, mode).select(
        "text", F.lit(6).alias("rank"), "division", F.lit("fuzzy").alias("stage"), F.col("span").alias("matched"))
    outside = alias_match(rest, "text", "text", geocoded_out.select(F.col("place_key").alias("alias_key"), F.col("district").alias("division")))
    outside = outside.select("text", F.lit(7).alias("rank"), out, F.lit("out_of_district").alias("stage"), F.col("division").alias("matched"))
    return first.unionByName(keep_first(fuzzy.unionByName(outside), ["text"], [F.col("rank")])).drop("rank")


def match_cascade(df: DataFrame, fields: Sequence[str], resolved: DataFrame) -> DataFrame:
    """First field (in order) whose text resolves decides; adds division, match_stage, match_field, match_text.

    An out-of-district result is terminal: later fields are not consulted and the division stays NULL.
    """
    pick = F.lit(None).cast("struct<division:string,stage:string,matched:string,field:string>")
    for i, field in enumerate(fields):
        side = resolved.select(F.col("text").alias(f"__t{i}"), F.struct("division", "stage", "matched", F.lit(field).alias("field")).alias(f"__m{i}"))
        df = df.join(maybe_broadcast(side), F.col(field) == F.col(f"__t{i}"), "left").drop(f"__t{i}")
    pick = F.coalesce(*[F.col(f"__m{i}") for i in range(len(fields))])
    return df.withColumn("__p", pick).select(
        *[c for c in df.columns if not c.startswith("__m")],
        F.nullif(F.col("__p.division"), F.lit(OUT_OF_DISTRICT)).alias("division"),
        F.coalesce(F.col("__p.stage"), F.lit("unmatched")).alias("match_stage"),
        F.col("__p.field").alias("match_field"), F.col("__p.matched").alias("match_text"),
    )


def resolve_collision(df: DataFrame, name: str, lat: str, lon: str, candidates: DataFrame, owner: str) -> DataFrame:
    """Pick the candidate of a colliding name: the only one, else the nearest to the row's anchor, else ambiguous.

    `candidates`: name, owner, c_lat, c_lon. Rows are reduced to distinct (name, anchor), which look for the nearest candidate of
    their name cell by cell; a candidate without a point goes before those with one. Only coordinates that are no places on the
    sphere are compared with every candidate of the name.
    """
    placed = lambda a, b: F.coalesce(F.col(a).between(-90, 90) & F.col(b).between(-180, 180), F.lit(False))
    blank = lambda a, b: F.col(a).isNull() | F.col(b).isNull()
    stats = candidates.groupBy(name).agg(
        F.count("*").alias("__n"), F.min(F.struct(F.col(owner).alias("o"))).alias("__least"),
        F.min(F.when(blank("c_lat", "c_lon"), F.struct(F.col(owner).alias("o")))).alias("__blank"),
        F.max(~placed("c_lat", "c_lon") & ~blank("c_lat", "c_lon")).alias("__odd"))
    anchors = freeze(null_safe_join(df.select(name, lat, lon).distinct(), stats, [name], "left"))
    known = F.when(F.col(name).isNotNull(), F.when(blank(lat, lon), F.col("__least")).otherwise(F.col("__blank")))
    settled = F.col(name).isNull() | F.col("__n").isNull() | known.isNotNull()
    here = anchors.filter(settled).select(name, lat, lon, "__n", F.when(F.col("__n").isNotNull(), known["o"]).alias("__o"))
    open_ = anchors.filter(~settled)
    near = open_.filter(placed(lat, lon) & ~F.col("__odd"))
    spots = candidates.select(name, F.struct(F.col(owner).alias("o")).alias("__who"), F.col("c_lat").alias("t_lat"), F.col("c_lon").alias("t_lon"))
    found = nearest(near.select(name, F.col(lat).alias("lat"), F.col(lon).alias("lon")), spots, name, payload=["__who"], sphere_km=fv.MATCH_RADIUS_KM)
    found = found.select(name, F.col("lat").alias(lat), F.col("lon").alias(lon), F.col("__who.o").alias("__o"))
    close = near.select(name, lat, lon, "__n").join(found, [name, lat, lon], "left")
    km = geo.haversine(F.col(lat), F.col(lon), F.col("c_lat"), F.col("c_lon"), fv.MATCH_RADIUS_KM)
    odd = open_.filter(~(placed(lat, lon) & ~F.col("__odd"))).join(candidates, name, "left").groupBy(name, lat, lon).agg(
        F.max("__n").alias("__n"), F.min(F.struct(km.alias("km"), F.col(owner).alias("o"))).alias("b"))
    best = here.unionByName(close).unionByName(odd.select(name, lat, lon, "__n", F.col("b.o").alias("__o")))
    ambiguous = F.coalesce((F.col("__n") > 1) & blank(lat, lon), F.lit(False))
    decided = best.select(name, lat, lon, F.when(~ambiguous, F.col("__o")).alias(owner), ambiguous.alias("ambiguous"))
    return null_safe_join(df, decided, [name, lat, lon], "left")
