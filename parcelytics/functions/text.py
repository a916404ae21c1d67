"""Text normalisation as native column expressions (no Python in the row path)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelytics import fixed_values as fv

WORD = r"\p{L}\p{N}_\x{0D80}-\x{0DFF}"


def literal_array(values: Sequence) -> Column:
    return F.array(*[F.lit(v) for v in values])


def let(value: Column, use) -> Column:
    """`use(value)` with the value computed once, for expressions that read it inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def collapse_spaces(col: Column) -> Column:
    return F.btrim(F.regexp_replace(col, r"\s+", " "))


def reduce_name(name: Column, protected: Sequence[str] = fv.PROTECTED_NAMES) -> Column:
    """Struct(base, qualifiers): strip letter, town, cardinal and prefix qualifiers until none applies.

    Each round takes the first pattern that matches; `qualifiers` lists what was stripped, in order. A round removes one
    part of the name at least, so as many rounds as it has parts reach the end; `settled` says that the last changed nothing.
    """
    patterns = [(fv.LETTER_SUFFIX, 1, 2), (fv.TOWN_SUFFIX, 1, 2), (fv.CARDINAL_SUFFIX, 1, 2), (fv.SIZE_PREFIX, 2, 1)]

    def strip_once(s: Column) -> Column:
        chosen = F.lit(None).cast("struct<base:string,q:string>")
        for pattern, base_at, q_at in reversed(patterns):
            base = F.btrim(F.regexp_extract(s, pattern, base_at), F.lit(" -"))
            chosen = F.when(
                s.rlike(pattern) & (base != ""),
                F.struct(base.alias("base"), F.regexp_extract(s, pattern, q_at).alias("q")),
            ).otherwise(chosen)
        return chosen

    start = F.struct(
        collapse_spaces(name).alias("base"), F.array().cast("array<string>").alias("qualifiers"), F.lit(False).alias("settled")
    )

    def step(acc: Column, _: Column) -> Column:
        protected_now = (F.size(acc["qualifiers"]) == 0) & F.lower(acc["base"]).isin(list(protected))
        found = strip_once(acc["base"])
        done = protected_now | found.isNull()
        return F.struct(
            F.when(done, acc["base"]).otherwise(found["base"]).alias("base"),
            F.when(done, acc["qualifiers"]).otherwise(F.array_append(acc["qualifiers"], found["q"])).alias("qualifiers"),
            done.alias("settled"),
        )

    return F.aggregate(F.sequence(F.lit(1), _parts(name) + 1), start, step)


def _parts(name: Column) -> Column:
    """Number of parts between blanks and hyphens, at least 1."""
    return F.coalesce(F.size(F.split(name, r"[\s\-]+")), F.lit(1))


def sound_key(token: Column) -> Column:
    """Fold romanisation variants: aspirates, long vowels, w to v, then doubled letters."""
    out = F.lower(token)
    for old, new in [*fv.ASPIRATES, *fv.VOWELS, ("w", "v")]:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.regexp_replace(out, r"(.)\1+", "$1")


def tokenize(text: Column) -> Column:
    """Word tokens in order, pure digits dropped; NULL text gives an empty array. One pass of one pattern."""
    pattern = rf"\p{{Nd}}*[{WORD}&&[^\p{{Nd}}]][{WORD}]*"
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def latin_tokens(text: Column) -> Column:
    """Tokens that hold a Latin letter."""
    pattern = rf"[{WORD}&&[^a-zA-Z]]*[a-zA-Z][{WORD}]*"
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def latin_key(text: Column) -> Column:
    return F.array_join(F.transform(latin_tokens(text), sound_key), " ")


def script_base(
    name: Column,
    suffixes: Sequence[str] = fv.SCRIPT_SUFFIXES,
    prefixes: Sequence[str] = fv.SCRIPT_PREFIXES,
) -> Column:
    """Strip qualifier words (also when the last letter was truncated) from non-Latin names, to a fixpoint.

    A round that changes a name removes a character of it at least, and a word wherever words are parted by one blank;
    rounds in the number of blank-parted parts, plus the suffixes that stand without a blank, reach the end.
    """
    forms = [w for q in suffixes for w in (q, q[:-1]) if len(w) >= 2]

    def strip_suffix(s: Column) -> Column:
        out = s
        for form in reversed(forms):
            cut = F.btrim(F.left(s, F.length(s) - F.lit(len(form))))
            out = F.when(s.endswith(form) & s.contains(" ") & (cut != ""), cut).otherwise(out)
        return out

    def strip_prefixes(s: Column) -> Column:
        out = s
        for q in prefixes:
            out = F.when(out.startswith(q + " "), F.btrim(F.substring(out, len(q) + 1, 1_000_000))).otherwise(out)
        return out

    def step(acc: Column, _: Column) -> Column:
        return F.aggregate(F.array(strip_suffix(acc)), F.lit(""), lambda _a, x: strip_prefixes(x))

    return F.aggregate(F.sequence(F.lit(1), _parts(name) + F.coalesce(F.length(name), F.lit(0))), name, step)


def norm_key(col: Column) -> Column:
    """Collapse whitespace and lower-case."""
    return F.lower(collapse_spaces(F.coalesce(col, F.lit(""))))


def letters_only(col: Column) -> Column:
    return F.regexp_replace(F.lower(col), "[^a-z]", "")


def hyphens_to_spaces(col: Column) -> Column:
    return norm_key(F.replace(col, F.lit("-"), F.lit(" ")))


def norm_address(col: Column, noise: Sequence[str] = ("no", "nos", "sri", "lanka")) -> Column:
    """Punctuation to spaces, noise words dropped, spaces squeezed, lower case."""
    spaced = F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), r"[^a-z0-9]+", " ")
    dropped = F.regexp_replace(spaced, r"\b(" + "|".join(noise) + r")\b", " ")
    return collapse_spaces(dropped)


def shifted(tokens: Column, n: int) -> Column:
    """One struct (w0 .. w<n-1>) per position: the token and the n-1 tokens after it, NULL past the end."""
    return F.arrays_zip(*[
        (tokens if i == 0 else F.slice(tokens, F.lit(i + 1), F.greatest(F.size(tokens) - i, F.lit(0)))).alias(f"w{i}") for i in range(n)])


def ngrams(tokens: Column, n: int) -> Column:
    """All contiguous n-token slices joined by a space, in position order; empty when there are too few tokens."""
    def slices(words: Column) -> Column:
        whole = F.filter(shifted(words, n), lambda s: s[f"w{n - 1}"].isNotNull())
        return F.transform(whole, lambda s: F.concat_ws(" ", *[s[f"w{i}"] for i in range(n)]))

    return let(tokens, slices)


def is_all_filler(tokens: Column, filler: Sequence[str] = fv.FILLER_WORDS) -> Column:
    return F.forall(tokens, lambda t: F.lower(t).isin(list(filler)))


def has_any_substring(col: Column, words: Sequence[str]) -> Column:
    """Case-folded substring test against any of the words; NULL text is false."""
    low = F.lower(col)
    hit = F.lit(False)
    for word in words:
        hit = hit | low.contains(word)
    return F.coalesce(hit, F.lit(False))


def regex_code(col: Column, pattern: str, codes: dict[int, str]) -> Column:
    """Name of the first captured integer that is a known code."""
    found = F.transform(F.regexp_extract_all(col, F.lit(pattern), F.lit(1)), lambda s: s.cast("int"))
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return F.try_element_at(table, F.get(F.filter(found, lambda n: n.isin(list(codes))), F.lit(0)))


def distinctive_tokens(name: Column, generic: Sequence[str] = fv.GENERIC_TOKENS) -> Column:
    """Sorted set of Latin words of the name that carry information."""
    words = F.regexp_extract_all(F.lower(name), F.lit("[a-z]+"), F.lit(0))
    return F.array_sort(F.array_except(words, literal_array(generic)))


def spelling_variants(name: Column, swaps: Sequence[tuple[str, str]] = fv.SPELLING_SWAPS) -> Column:
    """The name and one variant per applicable swap, changed at its last occurrence; first spelling wins."""
    low = F.lower(name)
    variants = [name]
    for old, new in swaps:
        back = F.locate(old[::-1], F.reverse(low))
        at = F.length(name) - back - F.lit(len(old) - 1)
        swapped = F.concat(F.left(name, at), F.lit(new), F.substr(name, at + F.lit(len(old) + 1)))
        variants.append(F.when(back > 0, swapped))
    return distinct_ignoring_case(F.array_compact(F.array(*variants)))


def distinct_ignoring_case(names: Column) -> Column:
    return let(names, lambda every: F.filter(
        every,
        lambda v, i: ~F.exists(F.slice(every, F.lit(1), i), lambda earlier: F.lower(earlier) == F.lower(v)),
    ))


def name_variants(
    name: Column,
    locality: Column,
    type_prefixes: Sequence[str] = (),
    generic: Sequence[str] = fv.GENERIC_TOKENS,
) -> Column:
    """Mechanical rewrites of a register name: drop the article, swap type and place, append the locality.

    A rewrite that loses a distinctive token is not offered.
    """
    low = F.lower(name)
    article = low.startswith("the ")
    variants = [name, F.when(article, F.substring(name, 5, 1_000_000))]
    no_prefix = F.lit(True)
    for prefix in type_prefixes:
        applies = no_prefix & low.startswith(prefix.lower())
        place = F.btrim(F.substring(name, len(prefix) + 1, 1_000_000))
        for built in (
            F.concat_ws(" ", place, F.lit(prefix)), F.concat_ws(" ", F.lit(prefix), place),
            F.concat_ws(" ", place, F.lit("hospital")),
        ):
            variants.append(F.when(applies & (place != ""), built))
        no_prefix = no_prefix & ~low.startswith(prefix.lower())
    typed = r"(?i)^(.*?)\s+(Hospital|University|School|College|Institute)\b(.*)$"
    head = F.regexp_extract(name, typed, 1)
    variants.append(
        F.when(no_prefix & (head != ""), F.btrim(F.concat_ws(" ", F.regexp_extract(name, typed, 2), head)))
    )
    of_form = r"(?i)^University of (?:the )?(.+)$"
    rest = F.regexp_extract(name, of_form, 1)
    variants += [F.when(rest != "", F.concat(rest, F.lit(" University"))), F.when(rest != "", rest)]
    place = F.btrim(F.split(F.coalesce(locality, F.lit("")), ",")[0])
    base = F.when(article, F.substring(name, 5, 1_000_000)).otherwise(name)
    variants.append(
        F.when((place != "") & ~F.contains(F.lower(base), F.lower(place)), F.concat_ws(" ", base, place))
    )
    words = lambda v: F.regexp_extract_all(F.lower(v), F.lit("[a-z]+"), F.lit(0))
    tidy = let(distinctive_tokens(name, generic), lambda needed: F.filter(
        F.transform(F.array_compact(F.array(*variants)), collapse_spaces),
        lambda v: (v != "") & (F.size(F.array_except(needed, words(v))) == 0),
    ))
    return let(distinct_ignoring_case(tidy), lambda unique: F.when(F.size(unique) > 0, unique).otherwise(F.array(name)))


def name_similarity_bounds(length: Column, cutoff: float) -> tuple[Column, Column]:
    """Shortest and longest partner whose edit ratio with a text of this length can reach the cutoff."""
    return F.ceil(F.lit(cutoff) * length), F.floor(length / F.lit(cutoff))


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def count_occurrences(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of a literal term."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / F.lit(len(term))).cast("long")


def display_label(column_name: Column, prefix: str = "") -> Column:
    """'Land_type_A_B' -> 'A / B'."""
    stripped = F.when(column_name.startswith(prefix), F.substring(column_name, len(prefix) + 1, 1_000_000)).otherwise(
        column_name
    )
    return F.replace(stripped, F.lit("_"), F.lit(" / "))


def title_label(col: Column, fallback: str = "Unknown") -> Column:
    return F.coalesce(F.initcap(col), F.lit(fallback))
