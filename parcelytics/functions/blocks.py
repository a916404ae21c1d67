"""Matching-block similarity of many pairs of texts at once: the longest common block, then the same left and right of it.

The ratio is 2 * matched characters / total length (Ratcliff and Obershelp). All pairs of a batch go through the recursion
together: the places where both texts have the same character are one flat table, a block is a run of such places along a
diagonal, and a round takes the longest run of every open part of every pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts of this length or more leave out, as starts of blocks, characters of the right text that make up over one in a hundred of it.
POPULAR_FROM = 200
#: Pairs of equal characters that are held at a time (or those of one pair).
_PLACES = 1 << 20
#: Bytes of a text whose windows are worked out at a time, and windows after which rows are handed on.
_SLICE, _WINDOWS = 1 << 20, 1 << 20


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, offsets)."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return flat, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def _counts(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pair * 2^21 + character, how often) in order."""
    pair = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    return np.unique((pair << 21) | flat, return_counts=True)


def shared_characters(left: list[str], right: list[str]) -> np.ndarray:
    """Characters that the texts of each pair have in common, whatever their order: at least as many as blocks can match."""
    (a, n), (b, m) = _counts(*_codes(left)), _counts(*_codes(right))
    common, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    return np.bincount(common >> 21, np.minimum(n[i], m[j]), len(left)).astype(np.int64)


def _expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) for every value of every range [low, high)."""
    size = high - low
    row = np.repeat(np.arange(len(low)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + low[row]


def _agreeing(a: np.ndarray, b: np.ndarray, step: int) -> int:
    """How many characters agree from the starts of `a` and `b` on (step 1) or from their ends back (step -1)."""
    n, done = min(len(a), len(b)), 0
    while done < n:
        size = min(4096, n - done)
        x, y = (t[done : done + size] if step > 0 else t[len(t) - done - size : len(t) - done][::-1] for t in (a, b))
        differ = np.flatnonzero(x != y)
        if len(differ):
            return done + int(differ[0])
        done += size
    return n


def matched_characters(left: list[str], right: list[str], popular_from: int | None = POPULAR_FROM) -> np.ndarray:
    """Characters in the matching blocks of each pair. Of the longest blocks the one that starts first on the left, then on the right.

    With `popular_from`, a right text of that length or more offers no blocks in characters that make up over a hundredth of it
    (and one more); blocks found in the others are prolonged over them, and a part without any matches what both sides begin with.
    None starts blocks everywhere.
    """
    (a, at_a), (b, at_b) = _codes(left), _codes(right)
    n_b = np.diff(at_b)
    key, count = _counts(b, at_b)
    pair_b = np.repeat(np.arange(len(right)), n_b)
    order = np.argsort((pair_b << 21) | b, kind="stable")
    listed = ((pair_b << 21) | b)[order]
    if popular_from is not None:
        size = n_b[key >> 21]
        popular = key[(size >= popular_from) & (count > size // 100 + 1)]
        stay = ~np.isin(listed, popular)
        order, listed = order[stay], listed[stay]
    pair_a = np.repeat(np.arange(len(left)), np.diff(at_a))
    wanted = (pair_a << 21) | a
    low, high = np.searchsorted(listed, wanted, "left"), np.searchsorted(listed, wanted, "right")
    total = np.zeros(len(left), np.int64)
    ends = np.concatenate([[0], np.cumsum(high - low)])[at_a]
    if popular_from is not None:
        for p in np.flatnonzero((n_b >= popular_from) & (ends[1:] == ends[:-1])):
            total[p] = _agreeing(a[at_a[p] : at_a[p + 1]], b[at_b[p] : at_b[p + 1]], 1)
    begin = 0
    while begin < len(left):  # whole pairs, a bounded number of places
        stop = max(begin + 1, int(np.searchsorted(ends, ends[begin] + _PLACES, "right")) - 1)
        part = slice(at_a[begin], at_a[stop])
        i, k = _expand(low[part], high[part])
        i += at_a[begin]
        _count_blocks(a, b, at_a, at_b, pair_a[i], i, order[k], popular_from, total)
        begin = stop
    return total


def _count_blocks(a, b, at_a, at_b, pair, i, j, popular_from, total) -> None:
    """Add to `total` the characters in the blocks of the pairs whose places (i, j) these are."""
    part, parts = np.unique(pair, return_inverse=True)[::-1]
    # an open part: its pair and its ends on both sides
    low_a, high_a, low_b, high_b = at_a[parts], at_a[parts + 1], at_b[parts], at_b[parts + 1]
    prolong = (high_b - low_b >= popular_from) if popular_from is not None else np.zeros(len(parts), bool)
    while len(i):
        order = np.lexsort((i, i - j, part))
        part, i, j = part[order], i[order], j[order]
        new = np.ones(len(i), bool)
        new[1:] = (part[1:] != part[:-1]) | (i[1:] != i[:-1] + 1) | (j[1:] != j[:-1] + 1)
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(i)))
        best = np.lexsort((j[head], i[head], -size, part[head]))
        first = np.ones(len(best), bool)
        first[1:] = part[head][best][1:] != part[head][best][:-1]
        block, of = head[best[first]], part[head[best[first]]]
        x, y, n = i[block], j[block], size[best[first]]
        for k in np.flatnonzero(prolong[of]):
            p = of[k]
            back = _agreeing(a[low_a[p] : x[k]], b[low_b[p] : y[k]], -1)
            more = _agreeing(a[x[k] + n[k] : high_a[p]], b[y[k] + n[k] : high_b[p]], 1)
            x[k], y[k], n[k] = x[k] - back, y[k] - back, n[k] + back + more
        np.add.at(total, parts[of], n)
        # the places left of the block on both sides, and those right of it, are open; part p becomes 2p and 2p + 1
        at = np.searchsorted(of, part)
        before, after = (i < x[at]) & (j < y[at]), (i >= (x + n)[at]) & (j >= (y + n)[at])
        stay = before | after
        for k in np.flatnonzero(prolong[of] & (np.bincount(at[before], minlength=len(of)) == 0)):
            p = of[k]  # nothing to start a block from: what both sides begin with is matched
            total[parts[p]] += _agreeing(a[low_a[p] : x[k]], b[low_b[p] : y[k]], 1)
        side = np.stack([low_a[of], x + n], 1).ravel(), np.stack([x, high_a[of]], 1).ravel(), np.stack([low_b[of], y + n], 1).ravel(), np.stack([y, high_b[of]], 1).ravel()
        parts, prolong = np.repeat(parts[of], 2), np.repeat(prolong[of], 2)
        low_a, high_a, low_b, high_b = side
        part, i, j = (2 * at + after)[stay], i[stay], j[stay]


def ratios(left: list[str], right: list[str], cutoff: float = 0.0, popular_from: int | None = POPULAR_FROM) -> np.ndarray:
    """Ratio of each pair (1 for two empty texts); NaN where the shared characters already rule out `cutoff`."""
    size = np.array([len(x) + len(y) for x, y in zip(left, right)], np.int64)
    out = np.where(size == 0, 1.0, np.nan)
    keep = np.flatnonzero((size > 0) & (2.0 * shared_characters(left, right) / np.maximum(size, 1) >= cutoff)) if len(size) else np.empty(0, int)
    found = matched_characters([left[k] for k in keep], [right[k] for k in keep], popular_from)
    out[keep] = 2.0 * found / size[keep]
    return out


def matching_ratio(a: Column, b: Column, cutoff: float = 0.0) -> Column:
    """The ratio of two text columns, the order of arguments matters; null where one is null or where `cutoff` is out of reach."""

    @F.pandas_udf("double")
    def ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            out = np.full(len(left), np.nan)
            whole = np.flatnonzero((left.notna() & right.notna()).to_numpy())
            out[whole] = ratios(left.iloc[whole].tolist(), right.iloc[whole].tolist(), cutoff)
            yield pd.Series(out).astype("Float64").mask(np.isnan(out))

    return ratio(a, b)


def byte_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (key, text) the rows (key, window): the different windows of 3 and of 6 bytes (UTF-8), as big-endian numbers.

    A text of over a megabyte goes by slices, which can name a window again.
    """
    for batch in batches:
        keys, texts = batch.columns
        rows, found, held = [], [], 0

        def handed() -> pa.RecordBatch:
            at = np.repeat(np.array(rows, np.int64), [len(f) for f in found])
            return pa.RecordBatch.from_arrays([keys.take(pa.array(at)), pa.array(np.concatenate([np.empty(0, np.int64), *found]))], names=["__key", "__head"])

        for row in range(len(batch)):
            data = np.frombuffer(texts[row].as_buffer(), np.uint8)
            for begin in range(0, max(len(data) - 2, 0), _SLICE):
                b = data[begin : begin + _SLICE + 5].astype(np.int64)
                three = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
                found.append(np.concatenate([np.unique(three), np.unique(three[:-3] << 24 | three[3:])]))
                rows.append(row)
                held += len(found[-1])
                if held >= _WINDOWS:
                    yield handed()
                    rows, found, held = [], [], 0
        yield handed()
