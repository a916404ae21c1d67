"""Secret scan: fixed patterns, and sliding-window Shannon entropy over candidate strings, by DataFrame functions alone."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds in their order, their patterns (Java syntax), the group that is measured and its least length. A run
# of hex digits is taken whole, so looking for long runs that no digit precedes finds the same as dropping short ones.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
)
#: Candidates of the entropy scan: whole runs of these characters of the least length, with a letter and a digit.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: Characters in a window, and bits of entropy that some window of a candidate must reach, by its class of characters.
WINDOW = 20
CLASSES = (("hexadecimal", r"^(?:[0-9a-f]+|[0-9A-F]+)$", 3.0), ("alphanumeric", r"^[A-Za-z0-9]+$", 3.7), ("base64", r"^[A-Za-z0-9+/_=-]+$", 3.9))
#: Candidates that hold one of these, in either case, are not reported by their entropy.
ALLOWED = ("example", "sample", "dummy", "placeholder", "changeme", "xxxx", "0123456789", "abcdefghij", "license", "http")
#: Nor are candidates of this shape: identifiers that are public by design (UUID, digest of a public file).
ALLOWED_SHAPE = r"^(?:[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}|sha(?:256|384|512)-[A-Za-z0-9+/=]+)$"
MARK = "[SECRET]"
_SPANS = "array<struct<start:int,rank:int,end:int,kind:string,body:string>>"
_FIRST, _LAST = 43, 122  # a candidate's characters lie between '+' and 'z'


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once, however often `body` names it."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """Running sums (or any other associative `add`) of an array, in steps that double the reach: n log n in all."""
    reaches = F.array(*[F.lit(1 << k) for k in range(31)])

    def step(acc: Column, reach: Column) -> Column:
        return F.transform(acc, lambda v, at: F.when(at >= reach, add(F.get(acc, at - reach), v)).otherwise(v))

    return _bound(values, lambda v: F.aggregate(F.filter(reaches, lambda r: r < F.size(v)), v, step))


def matches(text: Column, kind: str, rank: int, pattern: str, group: int = 0, least: int = 1) -> Column:
    """Matches of `pattern`, leftmost and non-overlapping, whose `group` has `least` characters, as an array of spans.

    Start and end count code points, end exclusive. The parts between the matches and the matches themselves make up the
    text, so running sums of their lengths give the places.
    """
    lit = F.lit(pattern)
    whole = F.regexp_extract_all(text, lit, F.lit(0))
    measured = whole if group == 0 else F.regexp_extract_all(text, lit, F.lit(group))
    parts = F.zip_with(
        F.zip_with(whole, F.split(text, pattern, -1), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g"))), measured,
        lambda p, b: F.struct(p["m"].alias("m"), (p["g"] + F.length(p["m"])).alias("g"), F.length(b).alias("n")),
    )
    none = F.array().cast(_SPANS)

    def span(part: Column, end: Column) -> Column:
        return F.struct((end - F.length(part["m"])).alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"),
                        part["m"].alias("body"), part["n"].alias("n"))

    parts = F.filter(parts, lambda p: p["m"].isNotNull())  # the part behind the last match
    placed = _bound(parts, lambda ps: F.zip_with(ps, running(F.transform(ps, lambda p: p["g"]), lambda x, y: x + y), span))
    found = F.transform(F.filter(placed, lambda s: s["n"] >= least), lambda s: F.struct(*[s[c].alias(c) for c in ("start", "rank", "end", "kind", "body")]))
    return F.when(F.regexp_like(text, lit), found).otherwise(none)


def window_entropy(body: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy, in bits, of the windows of `window` characters of a candidate; 0 for a shorter one.

    Counts per character move with the window: a step adds one for the character that comes in and takes one from that
    which goes out, and the sum of c * log2(c) changes by those two alone.
    """
    codes = F.transform(F.split(body, ""), lambda c: F.ascii(c) - _FIRST)
    late = F.slice(F.concat(F.array_repeat(F.lit(-1), window), codes), F.lit(1), F.size(codes))
    steps = F.zip_with(codes, late, lambda i, o: F.struct(i.alias("i"), o.alias("o")))

    def term(c: Column) -> Column:
        return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))

    def step(acc: Column, at: Column) -> Column:
        counts = F.transform(acc["counts"], lambda c, k: c + (k == at["i"]).cast("int") - (k == at["o"]).cast("int"))
        comes, goes = F.get(acc["counts"], at["i"]), F.get(acc["counts"], at["o"])
        s = acc["s"] + F.when(at["i"] == at["o"], F.lit(0.0)).otherwise(
            term(comes + 1) - term(comes) + F.when(at["o"] < 0, F.lit(0.0)).otherwise(term(goes - 1) - term(goes))
        )
        full = acc["n"] + 1 >= window
        return F.struct(counts.alias("counts"), s.alias("s"), (acc["n"] + 1).alias("n"), F.when(full, F.least(acc["low"], s)).otherwise(acc["low"]).alias("low"))

    none = F.array_repeat(F.lit(0), _LAST - _FIRST + 1)
    start = F.struct(none.alias("counts"), F.lit(0.0).alias("s"), F.lit(0).alias("n"), F.lit(float("inf")).alias("low"))
    least = F.aggregate(steps, start, step, lambda acc: acc["low"])
    return F.when(F.length(body) < window, F.lit(0.0)).otherwise(F.lit(math.log2(window)) - least / window)


def _needed(body: Column) -> Column:
    out = F.lit(float("inf"))
    for _, pattern, bits in reversed(CLASSES):
        out = F.when(F.regexp_like(body, F.lit(pattern)), F.lit(bits)).otherwise(out)
    return out


def _suspicious(body: Column) -> Column:
    plain = F.lower(body)
    allowed = reduce(lambda a, b: a | b, [F.contains(plain, F.lit(w)) for w in ALLOWED]) | F.regexp_like(body, F.lit(ALLOWED_SHAPE))
    both = F.regexp_like(body, F.lit("[0-9]")) & F.regexp_like(body, F.lit("[A-Za-z]"))
    return both & ~allowed & (window_entropy(body) >= _needed(body))


def spans(text: Column) -> Column:
    """All secrets of a text by start, then kind: the fixed patterns, and candidates with a window of high entropy.

    Each is (start, rank, end, kind, body), in code points with an exclusive end. Null and empty texts have none; a very
    long text or candidate is read whole.
    """
    text = F.coalesce(text, F.lit(""))
    found = [matches(text, kind, rank, pattern, group, least) for rank, (kind, pattern, group, least) in enumerate(BASE)]
    high = F.filter(matches(text, "entropy", len(BASE), CANDIDATE), lambda s: _suspicious(s["body"]))
    return F.array_sort(F.concat(*found, high))


def scan(df: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """`df` with its secrets; other columns stay, a column called like `out` is replaced, an empty table gives no rows."""
    return df.withColumn(out, spans(F.col(text)))


def listed(found: Column) -> Column:
    """Spans as kind:start:end, joined by commas; the empty text for none."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind))


def redact(text: Column, found: Column, mark: str = MARK) -> Column:
    """The text with every secret replaced by `mark`; secrets that overlap become one mark. Null stays null.

    A very long text with many secrets is masked in slices of about ten times the root of its length, so that no step walks
    the text from its start.
    """
    n = F.length(text)
    ends = running(F.transform(found, lambda s: s["end"]), F.greatest)
    held = F.zip_with(found, ends, lambda s, e: F.struct(s["start"].alias("start"), e.alias("end")))

    def gaps(spans: Column) -> Column:
        """What stays: from the end of all spans before up to the next that starts behind it, and up to the end of the text."""
        before = F.transform(spans, lambda s, at: F.struct(
            F.coalesce(F.get(spans, at - 1)["end"], F.lit(0)).alias("first"), s["start"].alias("last"), F.lit(mark).alias("mark")))
        rest = F.struct(F.element_at(spans, -1)["end"].alias("first"), n.alias("last"), F.lit("").alias("mark"))
        return F.concat(F.filter(before, lambda g: g["last"] >= g["first"]), F.array(rest))

    def masked(stays: Column, width: Column) -> Column:
        slices = F.regexp_extract_all(text, F.concat(F.lit("(?s).{1,"), width.cast("string"), F.lit("}")), F.lit(0))

        def written(part: Column, k: Column) -> Column:
            low, high = k * width, (k + 1) * width

            def piece(g: Column) -> Column:
                first, last = F.greatest(g["first"], low), F.least(g["last"], high)
                return F.concat(F.substring(part, first - low + 1, last - first), F.when(g["last"] < high, g["mark"]).otherwise(""))

            return F.array_join(F.transform(F.filter(stays, lambda g: (g["first"] < high) & (g["last"] >= low)), piece), "")

        return F.array_join(F.transform(slices, written), "")

    width = F.pow(F.lit(2), F.ceil(F.log2(F.sqrt(n.cast("double")) * 10))).cast("int")
    done = _bound(_bound(held, gaps), lambda stays: _bound(width, lambda w: masked(stays, w)))
    return F.when(F.size(found) > 0, done).otherwise(text)
