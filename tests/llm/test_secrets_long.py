"""Secrets of long texts: places and masks against a plain walk, and a cost in proportion to the text."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from parcelytics.llm import secrets


def masked(text, spans, mark):
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_running_sums_and_maxima(spark):
    rng = random.Random(3)
    rows = [([rng.randint(-9, 9) for _ in range(n)],) for n in (0, 1, 2, 3, 5, 64, 65, 200)]
    df = spark.createDataFrame(rows, "v array<int>").select(
        "v", secrets.running(F.col("v"), lambda a, b: a + b).alias("sums"), secrets.running(F.col("v"), F.greatest).alias("tops"))
    for r in df.collect():
        assert r["sums"] == [sum(r["v"][: k + 1]) for k in range(len(r["v"]))]
        assert r["tops"] == [max(r["v"][: k + 1]) for k in range(len(r["v"]))]


def test_masks_over_slices_of_any_width(spark):
    """Spans that overlap, touch, lie in one another or reach over slices; text outside the basic plane."""
    rng = random.Random(5)
    rows = []
    for n in (1, 2, 3, 9, 40, 300, 2500):
        for _ in range(6):
            text = "".join(rng.choice("ab \né😀") for _ in range(n))
            spans = [sorted(rng.sample(range(n + 1), 2)) for _ in range(rng.randint(0, max(1, n // 6)))] if n > 1 else [(0, 1)]
            rows.append((text, sorted((s, 0, e, "hex", text[s:e]) for s, e in spans)))
    rows += [(None, []), ("", [])]
    df = spark.createDataFrame(rows, "text string, found " + secrets._SPANS)
    for r in df.withColumn("out", secrets.redact(F.col("text"), F.col("found"))).collect():
        want = masked(r["text"], [(s["start"], s["end"]) for s in r["found"]], secrets.MARK) if r["text"] is not None else None
        assert r["out"] == want


def test_many_secrets_cost_in_proportion(spark):
    """16,000 secrets in half a megabyte."""
    text = " ".join(f"token={k:08d}é filler text" for k in range(16_000))
    df = spark.createDataFrame([(text,)], "text string")
    scanned = secrets.scan(df)
    scanned.collect()
    begin = time.time()
    got = scanned.withColumn("masked", secrets.redact(F.col("text"), F.col("secrets"))).select("masked", F.size("secrets").alias("n")).first()
    spent = time.time() - begin
    assert got["n"] == 16_000
    assert got["masked"] == " ".join(f"{secrets.MARK}é filler text" for k in range(16_000))
    assert spent < 8, spent
