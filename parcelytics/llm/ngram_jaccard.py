"""N-gram Jaccard self-join: MinHash bands find candidates, a Bayesian test drops pairs early, the rest is verified exactly."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelytics.llm.graph import components
from parcelytics.session import freeze

#: Words in a shingle, similarity of a link, and the banding: a pair at exactly 0.8 shares none of 40 bands of five
#: MinHash values with probability (1 - 0.8^5)^40 = 1.3e-7.
WORDS, THRESHOLD, BANDS, ROWS = 5, 0.8, 40, 5
#: Posterior probability of reaching the threshold below which a pair is dropped, and values compared between two tests.
TOLERANCE, STEP = 1e-7, 20
#: Texts that one task compares with as many others at a time.
BLOCK = 256
_CHUNK = 2048


class _WordHashes(dict):
    """64-bit hash of a word, remembered for the words seen first."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < 500_000:
            self[word] = value
        return value


_HASHES = _WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of all runs of `words` lower-case words (cut at ASCII white space), repeats kept.

    A shorter text is one shingle; a text without words, or null, has none.
    """
    tokens = (text or "").lower().encode("utf-8", "replace").split()
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, tokens), np.uint64, len(tokens))
    n = min(words, len(tokens))
    out = np.full(len(tokens) - n + 1, n, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i]
    return _mixed(out)


def _family(size: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 2**32, (size, 1), np.uint32), rng.integers(0, 2**31, (size, 1), np.uint32) * np.uint32(2) + np.uint32(1))


def signature(hashes: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """MinHash values of a set of shingle hashes."""
    mask, factor = _family(size)
    low = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), _CHUNK):
        out = np.minimum(out, ((low[None, at : at + _CHUNK] ^ mask) * factor).min(axis=1))
    return out


def least_matches(threshold: float = THRESHOLD, size: int = BANDS * ROWS, tolerance: float = TOLERANCE) -> list[int]:
    """For n compared values: the fewest equal ones that keep a pair.

    With a uniform prior the similarity given m of n equal values is Beta(m + 1, n - m + 1); it reaches the threshold
    with the probability that a Binomial(n + 1, threshold) is at most m.
    """
    out = []
    for n in range(size + 1):
        total, m = 0.0, -1
        while total < tolerance and m < n:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def _surviving(a: np.ndarray, b: np.ndarray, same: bool, keep: list[int], sizes: tuple[np.ndarray, np.ndarray], threshold: float):
    """Index pairs that pass the size bound and every Bayesian test; `same`: both sides are one block."""
    sa, sb = sizes
    alive = np.minimum(sa[:, None], sb[None, :]) >= threshold * np.maximum(sa[:, None], sb[None, :]) - 1e-9
    if same:
        alive &= np.tri(len(sa), dtype=bool).T & ~np.eye(len(sa), dtype=bool)
    ia, ib = np.nonzero(alive)
    matches = np.zeros(len(ia), np.int32)
    for at in range(0, a.shape[1], STEP):
        if not len(ia):
            break
        for lo in range(0, len(ia), 65536):
            part = slice(lo, lo + 65536)
            matches[part] += (a[ia[part], at : at + STEP] == b[ib[part], at : at + STEP]).sum(axis=1, dtype=np.int32)
        on = matches >= keep[min(at + STEP, a.shape[1])]
        ia, ib, matches = ia[on], ib[on], matches[on]
    return ia, ib


def _intersections(left: list[np.ndarray], right: list[np.ndarray], ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the given pairs of sorted sets."""
    if len(ia) <= 256:
        return np.array([len(np.intersect1d(left[i], right[j], assume_unique=True)) for i, j in zip(ia, ib)], np.int64)
    ua, pa = np.unique(ia, return_inverse=True)
    ub, pb = np.unique(ib, return_inverse=True)
    sets = [left[i] for i in ua] + [right[j] for j in ub]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(ua), len(ub)), np.float32)
    width = 4096
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        s, e = np.searchsorted(column, [lo, lo + width])
        grid = np.zeros((len(sets), width), np.float32)
        grid[owner[s:e], column[s:e] - lo] = 1
        total += grid[: len(ua)] @ grid[len(ua) :].T
    return total[pa, pb].astype(np.int64)


def _roots(n: int, ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
    root = np.arange(n)
    while len(ia):
        low = np.minimum(root[ia], root[ib])
        new = root.copy()
        np.minimum.at(new, ia, low)
        np.minimum.at(new, ib, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def _compare(threshold: float, keep: list[int]):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("text_key", kind="stable").reset_index(drop=True)
        same = bool((rows["side"] == 2).all())
        sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
        sigs = np.stack([np.frombuffer(x, np.uint32) for x in rows["sig"]])
        sizes = np.array([len(s) for s in sets])
        left = np.arange(len(rows)) if same else np.flatnonzero(rows["side"].to_numpy() == 0)
        right = left if same else np.flatnonzero(rows["side"].to_numpy() == 1)
        if not len(left) or not len(right):
            return pd.DataFrame({"text_key": [], "links": [], "root": []})
        ia, ib = _surviving(sigs[left], sigs[right], same, keep, (sizes[left], sizes[right]), threshold)
        ia, ib = left[ia], right[ib]
        common = _intersections(sets, sets, ia, ib)
        linked = common >= threshold * (sizes[ia] + sizes[ib] - common) - 1e-9
        ia, ib = ia[linked], ib[linked]
        copies = rows["copies"].to_numpy()
        links = np.zeros(len(rows), np.int64)
        np.add.at(links, ia, copies[ib])
        np.add.at(links, ib, copies[ia])
        on = np.flatnonzero(links)
        keys = rows["text_key"].to_numpy()
        return pd.DataFrame({"text_key": keys[on], "links": links[on], "root": keys[_roots(len(rows), ia, ib)[on]]})

    return run


def _banded(id_column: str, text_column: str, words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, bands, seen = [], [], {}
            for text in batch[text_column]:
                text = text or ""
                key = hashlib.md5(text.encode("utf-8", "replace")).digest()
                if key not in seen:
                    found = shingles(text, words)
                    seen[key] = signature(found).reshape(BANDS, ROWS).tobytes() if len(found) else None
                keys.append(key)
                bands.append(seen[key])
            yield pd.DataFrame({"doc_id": batch[id_column], "text_key": keys, "sig": bands})

    return run


def _detailed(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [np.unique(shingles(t, words)) for t in batch["text"]]
            yield pd.DataFrame({
                "text_key": batch["text_key"], "sig": [signature(s).tobytes() for s in sets], "shingles": [s.tobytes() for s in sets],
            })

    return run


def text_links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(members, links): `members` has doc_id, text_key and blank (no words) of every row, `links` the partial results of the comparisons.

    `links` rows are (text_key, links, root): how many rows (copies counted) of other texts a task found linked to the
    text, and the smallest text the task could reach from it. A text's links add up over its rows.

    Plan: MinHash bands give buckets. A text's home is the largest of its buckets, or a larger home beside it; two homes
    are compared when some bucket holds texts of both, so each pair of texts meets in one task at most, however many
    bands it shares. Homes are cut into blocks, and no pair is ever a row: a group of near copies costs rows in proportion to its size times its
    number of blocks.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # pass 1: one scan gives the key of the text and its signature
    id_type = dict(slim.dtypes)["doc_id"]
    signed = freeze(slim.mapInPandas(_banded("doc_id", "text", words), f"doc_id {id_type}, text_key binary, sig binary"))
    members = signed.select("doc_id", "text_key", F.col("sig").isNull().alias("blank"))
    width = ROWS * 4
    distinct = signed.filter("sig IS NOT NULL").groupBy("text_key").agg(F.count("*").alias("copies"), F.first("sig").alias("sig"))
    # `node` may collide for different texts: both are then candidates, and the comparison tells them apart by text_key
    banded = distinct.select(
        F.xxhash64("text_key").alias("node"),
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring("sig", b * width + 1, F.lit(width))))).alias("bucket"),
    )
    full = banded.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    crowded = freeze(banded.join(full, "bucket"))
    home = freeze(crowded.groupBy("node").agg(F.max(F.struct("n", "bucket")).alias("h")).select("node", F.col("h.bucket").alias("home")))
    # a home joins the largest home that shares a bucket with it, so a group of near copies isn't scattered over many homes
    size = home.groupBy("home").agg(F.count("*").alias("size"))
    near = crowded.select("bucket", "node").join(home, "node").select("bucket", "home").distinct().join(size, "home")
    leader = near.groupBy("bucket").agg(F.max(F.struct("size", "home")).alias("top"))
    leader = near.join(leader, "bucket").groupBy("home").agg(F.max("top").alias("top")).select("home", F.col("top.home").alias("cell"))
    home = home.join(leader, "home").select("node", F.col("cell").alias("home"))
    blocks = home.groupBy("home").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    homes = freeze(home.join(blocks, "home").withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int")))
    # pairs of homes that some bucket joins
    in_bucket = crowded.select("bucket", "node").join(homes.select("node", "home", "blocks"), "node").select("bucket", "home", "blocks").distinct()
    several = in_bucket.groupBy("bucket").agg(F.count("*").alias("k")).filter("k > 1").select("bucket")
    mixed = freeze(in_bucket.join(several, "bucket"))
    across = (
        mixed.select("bucket", F.col("home").alias("ha"), F.col("blocks").alias("na"))
        .join(mixed.select("bucket", F.col("home").alias("hb"), F.col("blocks").alias("nb")), "bucket")
        .filter("ha < hb").select("ha", "na", "hb", "nb").distinct()
    )
    inside = homes.select(F.col("home").alias("ha"), F.col("blocks").alias("na")).distinct()
    inside = inside.select("ha", "na", F.col("ha").alias("hb"), F.col("na").alias("nb"))
    tasks = (
        across.unionAll(inside)
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("na") - 1)))
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .filter("ha < hb OR i <= j").select("ha", "i", "hb", "j")
    )
    one = F.expr("ha = hb AND i = j")
    sides = F.when(one, F.array(F.struct(F.col("ha").alias("home"), F.col("i").alias("block"), F.lit(2).alias("side")))).otherwise(F.array(
        F.struct(F.col("ha").alias("home"), F.col("i").alias("block"), F.lit(0).alias("side")),
        F.struct(F.col("hb").alias("home"), F.col("j").alias("block"), F.lit(1).alias("side")),
    ))
    tasks = tasks.withColumn("s", F.explode(sides)).select("ha", "i", "hb", "j", "s.home", "s.block", "s.side")
    # pass 2: shingles of the candidates only
    wanted = distinct.select("text_key", "copies", F.xxhash64("text_key").alias("node")).join(homes.select("node", "home", "block"), "node")
    wanted = freeze(wanted.select("text_key", "copies", "home", "block"))
    # copies become one row in the map tasks, before anything meets by key; the candidates grow with the table, so they are
    # merged in and never broadcast
    once = slim.select(F.unhex(F.md5("text")).alias("text_key"), "text").groupBy("text_key").agg(F.first("text").alias("text"))
    texts = once.join(wanted.select("text_key").hint("merge"), "text_key")
    detail = freeze(texts.mapInPandas(_detailed(words), "text_key binary, sig binary, shingles binary"))
    rows = tasks.join(wanted, ["home", "block"]).join(detail, "text_key").select("ha", "i", "hb", "j", "side", "text_key", "copies", "sig", "shingles")
    compare = _compare(threshold, least_matches(threshold))
    links = freeze(rows.groupBy("ha", "i", "hb", "j").applyInPandas(compare, "text_key binary, links long, root binary"))
    return members, links


def jaccard_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, kept.

    Two documents are linked when the Jaccard similarity of their sets of word shingles is at least `threshold`; equal
    texts are. `n_links` counts a document's links, copies included; `class_id` is the smallest doc_id that links reach,
    and `kept` marks one row of each class. A text without words (null, empty, white space) is linked with nothing and
    is a class of its own row: class_id is its doc_id. Repeated rows and ids are counted as they stand; a row whose
    doc_id is null takes part, and a class of such rows alone has a null class_id and keeps all of its rows. An empty
    table gives no rows; other columns are ignored.
    """
    members, texts = _classes(docs, doc_id, text, words, threshold)
    own = F.col("blank")
    return members.join(texts, "text_key").select(
        "doc_id", F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(own, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        (own | F.coalesce(F.col("doc_id") == F.col("class_id"), F.col("class_id").isNull())).alias("kept"),
    )


def _classes(docs: DataFrame, doc_id: str, text: str, words: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(members, texts): doc_id, text_key and blank of every row; class_id and n_links of every text."""
    members, links = text_links(docs, doc_id, text, words, threshold)
    groups = members.groupBy("text_key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"))
    linked = links.groupBy("text_key").agg(F.sum("links").alias("links"))
    roots = components(links, "text_key", "root").withColumnRenamed("node", "text_key")
    texts = freeze(groups.join(linked, "text_key", "left").join(roots, "text_key", "left").select(
        "text_key", "least", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "text_key").alias("root"),
    ))
    classes = texts.groupBy("root").agg(F.min("least").alias("class_id"))
    return members, texts.join(classes, "root").select("text_key", "class_id", "n_links")


def first_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that near-duplicate removal keeps, with their columns.

    Of every class the document with the smallest id stays, once where its row repeats; texts without words all stay; a
    class without any id keeps each of its texts once.
    """
    members, texts = _classes(docs, doc_id, text, words, threshold)
    keep = members.join(texts, "text_key").filter(~F.col("blank") & F.coalesce(F.col("doc_id") == F.col("class_id"), F.col("class_id").isNull()))
    keep = keep.select(F.col("text_key").alias("__key"), F.col("class_id").alias("__class")).distinct()
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.withColumn("__key", F.unhex(F.md5(body))).withColumn("__class", F.col(doc_id))
    blank = docs.filter(~F.regexp_like(body, F.lit(r"[^\x20\x09-\x0D]")))
    # by text and id, so that the copies of a text are spread over the tasks; rows without an id become one per text first
    named = keyed.filter("__class IS NOT NULL").join(keep.filter("__class IS NOT NULL").hint("merge"), ["__key", "__class"]).dropDuplicates(["__key", "__class"])
    nameless = keyed.filter("__class IS NULL").dropDuplicates(["__key"]).join(keep.filter("__class IS NULL").select("__key"), "__key")
    return named.select(*docs.columns).unionByName(nameless.select(*docs.columns)).unionByName(blank)
