"""Substring dedup: Rabin-Karp hashes of every window of words, counted in Spark; repeated windows merge into maximal removal intervals."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words in a window.
WINDOW = 50
#: Bytes of text in a portion (rows of neighbouring keys that one task holds at a time) and of hashes in a bucket.
PORTION, BUCKET = 8 << 20, 16 << 20
#: Bytes of text whose words are hashed at a time (or one longer text).
_PIECE = 1 << 20
# Odd multipliers of the hashes modulo 2^64: of the bytes of a word, and two of the words of a window.
_BYTES, _FIRST, _SECOND = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F


def _mixed(x: np.ndarray, by: int = 0xFF51AFD7ED558CCD) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(by)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _polynomials(values: np.ndarray, begin: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Sum of values[begin + k] * base^-k over every run [begin, end), modulo 2^64, by differences of one running sum."""
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _powers(pow(base, -1, 2**64), n), out=total[1:])
    return (total[end] - total[begin]) * _powers(base, n)[begin]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words of every text); words are cut at ASCII white space and are otherwise unchanged."""
    hashes, counts = [], []
    at = 0
    while at < len(texts):
        stop, size = at + 1, len(texts[at])
        while stop < len(texts) and size + len(texts[stop]) <= _PIECE:
            size += len(texts[stop])
            stop += 1
        data = np.frombuffer(b" " + b" ".join(texts[at:stop]) + b" ", np.uint8)
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        begin = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
        end = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
        hashes.append(_mixed(_polynomials(data.astype(np.uint64) + np.uint64(1), begin, end, _BYTES) ^ (end - begin).astype(np.uint64)))
        bounds = np.cumsum([1] + [len(t) + 1 for t in texts[at:stop]])
        counts.append(np.diff(np.searchsorted(begin, bounds)))
        at = stop
    return (np.concatenate(hashes), np.concatenate(counts)) if texts else (np.empty(0, np.uint64), np.empty(0, np.int64))


def window_hashes(words: np.ndarray, counts: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first hash, second hash, index of the first word, text) of every window that lies within one text."""
    text = np.repeat(np.arange(len(counts)), counts)
    if len(words) < window:
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), np.empty(0, np.uint64), none, none
    start = np.flatnonzero(text[: len(words) - window + 1] == text[window - 1 :])
    one = _mixed(_polynomials(words, start, start + window, _FIRST))
    two = _mixed(_polynomials(_mixed(words, 0x9FB21C651E98DF25), start, start + window, _SECOND))
    return one, two, start, text[start]


def _runs(covered: np.ndarray, counts: np.ndarray) -> list[list[dict]]:
    """Maximal runs of covered words of each text, as word positions from 0, end exclusive."""
    out, at = [], 0
    for n in counts:
        if not covered[at : at + n].any():
            out.append([])
            at += n
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[False], covered[at : at + n], [False]]).astype(np.int8)))
        out.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])])
        at += n
    return out


def _portions(df: DataFrame, key: str, text: str) -> tuple[DataFrame, int]:
    """`df` with `__place` and `__part`, and the number of buckets.

    Places grow with the key and hold about PORTION bytes of text each; a key that fills several has a place of its own, which is
    dealt into parts by a hash of the text, as are the rows without a key (place -1). What reaches the driver is one bound per
    place, eight bytes for PORTION bytes of text.
    """
    size = df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes")).first()["bytes"]
    wanted = max(1, -(-size // PORTION))
    shares = [k / wanted for k in range(1, wanted)]
    found = df.agg(F.percentile_approx(key, shares, max(10_000, 20 * wanted)).alias("b")).first()["b"] if shares else None
    times = Counter(float(b) for b in found or [])
    hot = {b: n + 1 for b, n in times.items() if n > 1 and abs(b) < 2**53}  # beyond, different integers share a float
    splits = [-math.inf, *sorted({*times, *(math.nextafter(b, math.inf) for b in hot)}), math.inf]
    place, parts = F.lit(0), F.lit(1)
    keyed = df
    if len(splits) > 2:
        cut = Bucketizer(splits=splits, inputCol="__number", outputCol="__place", handleInvalid="keep")
        keyed = cut.transform(df.withColumn("__number", F.col(key).cast("double"))).drop("__number")
        place = F.col("__place").cast("int")
        for b, n in hot.items():
            parts = F.when(place == splits.index(b), n).otherwise(parts)
    none = F.col(key).isNull()
    keyed = keyed.withColumn("__part", F.pmod(F.xxhash64(text), F.when(none, wanted).otherwise(parts)).cast("int"))
    return keyed.withColumn("__place", F.when(none, -1).otherwise(place)), max(1, -(-size // BUCKET))


def _split(values: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The different `groups` in order, and the bytes of the values of each, in the order given."""
    if not len(values):
        return groups, []
    order = np.argsort(groups, kind="stable")
    values, groups = values[order], groups[order]
    cut = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    return groups[cut], [p.tobytes() for p in np.split(values, cut[1:])]


def _repeats(one: np.ndarray, rank: np.ndarray, answers: np.ndarray) -> np.ndarray:
    """Whether each window (its hash, its key's rank) is among the answers or has a smaller key here."""
    out = np.isin(one, answers)
    if len(one):
        order = np.argsort(one, kind="stable")
        head = np.flatnonzero(np.concatenate([[True], one[order][1:] != one[order][:-1]]))
        least = np.minimum.reduceat(rank[order], head)
        out[order] |= rank[order] > np.repeat(least, np.diff(np.append(head, len(one))))
    return out


def _without(body: bytes, gone: list[dict]) -> bytes:
    """The words of a text outside the intervals, joined by one space."""
    words, kept, at = body.split(), [], 0
    for run in gone:
        kept += words[at : run["start"]]
        at = run["end"]
    return b" ".join(kept + words[at:])


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """`df`, its text replaced by n_words, n_removed, removed (maximal intervals of word positions) and kept (the other words, joined by one space).

    A word is removed if a window over it has a word sequence that also starts in a row with a smaller (numeric) key. Windows are
    judged on the input: a removed window still counts against later rows. Null and empty texts have no words; rows with a null
    key neither lose words nor take any; rows of the same key, repeated ones too, don't count against each other, each keeps its
    own result. Texts shorter than a window lose nothing. An empty table gives no rows. Columns with the names of results are
    replaced, others stay. A very long text is held whole by one task, never cut.

    Rows meet by places of neighbouring keys. A place sends each of its hashes once to a bucket, which answers every place but the
    first that has the hash: there the window is a repeat, whatever row it is in. So a passage of a third of all rows costs one
    value a place, and no key has to travel. Repeats between rows of one place are found where its texts are. A bucket is
    chosen by the second hash and compares the first: two different windows are taken as equal with a chance of about 2^-64 per
    pair in a bucket of bounded size, below 1 in 10^12 windows on the whole.
    """
    own = ("n_words", "n_removed", "removed", "kept", text)
    keyed, buckets = _portions(df, key, text)
    rest = F.struct(*[c for c in df.columns if c not in own])
    slim = keyed.select("__place", "__part", F.col(key).alias("__key"), F.col(text).cast("binary").alias("__text"), rest.alias("__row"))

    def hashed(table: pa.Table):
        words, counts = word_hashes([t or b"" for t in table["__text"].to_pylist()])
        return words, counts, *window_hashes(words, counts, window)

    def sent(table: pa.Table) -> pa.Table:
        _, _, one, two, _, _ = hashed(table if table["__place"][0].as_py() >= 0 else table.slice(0, 0))  # no key: compared with nothing
        one, first = np.unique(one, return_index=True)
        bucket, hashes = _split(one, (two[first] % np.uint64(buckets)).astype(np.int64))
        ends = [np.full(len(hashes), table[c][0].as_py(), np.int32) for c in ("__place", "__part")]
        return pa.table([pa.array(bucket, pa.int64()), *map(pa.array, ends), pa.array(hashes, pa.binary())], ["bucket", "place", "part", "hashes"])

    def answered(table: pa.Table) -> pa.Table:
        table = table.sort_by([("place", "ascending"), ("part", "ascending")])
        parts = [np.frombuffer(h, np.uint64) for h in table["hashes"].to_pylist()]
        hashes, row = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        order = np.argsort(hashes, kind="stable")
        hashes, row = hashes[order], row[order]
        place = table["place"].to_numpy()[row]
        head = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        later = place > np.repeat(place[head], np.diff(np.append(head, len(hashes))))
        row, found = _split(hashes[later], row[later])
        ends = [table[c].to_numpy()[row] for c in ("place", "part")]
        return pa.table([*[pa.array(e, pa.int32()) for e in ends], pa.array(found, pa.binary())], ["place", "part", "hashes"])

    def marked(rows: pa.Table, answers: pa.Table) -> pa.Table:
        words, counts, one, _, start, text_of = hashed(rows)
        known = np.concatenate([np.empty(0, np.uint64), *[np.frombuffer(h, np.uint64) for h in answers["hashes"].to_pylist()]])
        if rows["__place"][0].as_py() < 0:
            repeat = np.zeros(len(one), bool)
        else:
            rank = np.unique(rows["__key"].to_numpy(), return_inverse=True)[1]
            repeat = _repeats(one, rank[text_of], known)
        begins = np.bincount(start[repeat], minlength=len(words) + 1)
        depth = begins - np.concatenate([np.zeros(window, np.int64), begins])[: len(words) + 1]
        runs = _runs(np.cumsum(depth[:-1]) > 0, counts)
        kept = [_without(body or b"", gone) for body, gone in zip(rows["__text"].to_pylist(), runs)]
        removed = [sum(r["end"] - r["start"] for r in gone) for gone in runs]
        spans = pa.array(runs, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
        return pa.table(
            [rows["__row"], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), spans, pa.array(kept, pa.binary())],
            ["__row", "n_words", "n_removed", "removed", "kept"],
        )

    requests = slim.groupBy("__place", "__part").applyInArrow(sent, "bucket long, place int, part int, hashes binary")
    answers = requests.groupBy("bucket").applyInArrow(answered, "place int, part int, hashes binary")
    span = "array<struct<start: int, end: int>>"
    schema = T.StructType([slim.schema["__row"]] + T._parse_datatype_string(f"n_words long, n_removed long, removed {span}, kept binary").fields)
    done = slim.groupBy("__place", "__part").cogroup(answers.groupBy("place", "part")).applyInArrow(marked, schema)
    return done.select("__row.*", "n_words", "n_removed", "removed", F.col("kept").cast("string").alias("kept"))
