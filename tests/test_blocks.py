"""Matching-block ratio of many pairs at once against the standard library's pair by pair."""

from __future__ import annotations

import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelytics.functions import blocks

CASES = {
    "two letters": ("ab", 12), "names": ("abcdefgh ", 30), "many letters": ("abcdefghijklmnopqrstuvwxyz é漢😀", 24), "long, all characters popular": ("abcdefghijklmnopqrst ", 900),
    "long, few characters popular": ("".join(chr(0x4E00 + k) for k in range(400)) + "ab", 900),
    "long, some characters popular": ("etaoin shrdlu" * 20 + "".join(chr(0x4E00 + k) for k in range(60)), 2500), "about the length limit": ("abc" * 30 + "xyz", 260),
}


def pairs_of(alphabet: str, longest: int, n: int = 120) -> tuple[list[str], list[str]]:
    rng = random.Random(longest)
    text = lambda: "".join(rng.choice(alphabet) for _ in range(rng.randrange(longest)))
    left, right = [text() for _ in range(n)], []
    for x in left:
        y = list(x)
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(y) + 1)
            y[at : at + rng.randrange(3)] = rng.choice(alphabet)
        right.append("".join(y) if rng.random() < 0.7 else text())
    return left, right


@pytest.mark.parametrize("case", CASES)
def test_ratio_is_that_of_single_pairs(case, monkeypatch):
    left, right = pairs_of(*CASES[case])
    want = [difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(left, right)]
    assert blocks.ratios(left, right).tolist() == want
    monkeypatch.setattr(blocks, "_PLACES", 100)  # a few pairs at a time
    assert blocks.ratios(left[:40], right[:40]).tolist() == want[:40]
    plain = [difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(left[:20], right[:20])]
    assert blocks.ratios(left[:20], right[:20], popular_from=None).tolist() == plain


def test_bound_only_drops_what_cannot_reach_the_cutoff():
    left, right = pairs_of("abcdefgh ", 30, 600)
    exact, cut = blocks.ratios(left, right), blocks.ratios(left, right, 0.8)
    assert (np.isnan(cut) | (cut == exact)).all() and not np.isnan(cut[exact >= 0.8]).any() and np.isnan(cut).any()
    assert (2 * blocks.shared_characters(left, right) >= exact * [len(x) + len(y) for x, y in zip(left, right)]).all()


def test_ratio_column(spark):
    rows = [("abcd", "bcde"), ("", ""), ("a", None), (None, None), ("x", "y"), ("abcd", "bcde")]
    df = spark.createDataFrame(rows, "a string, b string")
    found = df.select(blocks.matching_ratio(F.col("a"), F.col("b")).alias("r"), blocks.matching_ratio(F.col("a"), F.col("b"), 0.9).alias("cut")).collect()
    assert [r["r"] for r in found] == [0.75, 1.0, None, None, 0.0, 0.75]
    assert [r["cut"] for r in found] == [None, 1.0, None, None, None, None]
    assert df.limit(0).select(blocks.matching_ratio(F.col("a"), F.col("b"))).collect() == []
