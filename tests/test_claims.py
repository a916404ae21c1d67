"""Pins claimed in order over many tiles, over the date line, at the poles, and along chains, against a plain walk."""

from __future__ import annotations

import math
import random

import pytest

from parcelytics import fixed_values as fv
from parcelytics.operators import spatial
from parcelytics.plans import claims

METRES = 100.0
STEP = math.degrees(METRES / 1000 / fv.MATCH_RADIUS_KM)
NAMES = ["red ring", "blue bolt", "old gear", "red bolt", "grey", None, ""]


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    s, t = math.sin((q - p) / 2), math.sin(math.radians(b[1] - a[1]) / 2)
    return 2 * fv.MATCH_RADIUS_KM * math.asin(math.sqrt(min(s * s + math.cos(p) * math.cos(q) * t * t, 1.0)))


def walk(units):
    live, out = [], {}
    for i, name, lat, lon in sorted(units):
        owner = next((u for u in live if lat is not None and km((u[2], u[3]), (lat, lon)) * 1000 <= METRES), None)
        words = set((name or "").split())
        out[i] = "free" if owner is None else "shared" if words & set((owner[1] or "").split()) else "blocked"
        if out[i] != "blocked" and lat is not None:
            live.append((i, name, lat, lon))
    return out


def verdicts(spark, units):
    df = spark.createDataFrame(units, "id long, name string, lat double, lon double")
    return {r["id"]: r["verdict"] for r in spatial.claim_pins(df, "id", "name", METRES).collect()}


@pytest.mark.parametrize("lat, lon, tall, broad", [(6.9, 79.9, 40, 40), (-33.0, 179.9999, 12, 12), (89.9995, 10.0, 1, 150_000), (60.0, -180.0, 100, 6)])
def test_against_a_plain_walk(spark, monkeypatch, lat, lon, tall, broad):
    """Tiles of a few radii, cut further, so that many chains cross their borders."""
    monkeypatch.setattr(claims, "TILE_RADII", 8)
    monkeypatch.setattr(claims, "PARTS", 2)
    monkeypatch.setattr(claims, "TILE_CANDIDATES", 5)
    rng = random.Random(lat)
    units = []
    for i in range(500):
        x = lon + rng.randint(0, broad) * STEP * 0.7 - broad * STEP * 0.35
        units.append((i, rng.choice(NAMES), min(lat + rng.randint(0, tall) * STEP * 0.7, 90.0), (x + 180) % 360 - 180))
    units += [(900, "red", None, None), (901, "red", None, 3.0)]
    rng.shuffle(units)
    assert verdicts(spark, units) == walk(units)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """600 pins in a row, each in reach of the last alone: every second is turned away; the rounds are those of the tiles."""
    rounds = []
    own = claims.freeze
    monkeypatch.setattr(claims, "freeze", lambda df: rounds.append(1) or own(df))
    units = [(k, f"name{chr(97 + k % 26)}", 7.0 + k * STEP * 0.9, 80.0) for k in range(600)]
    got = verdicts(spark, units)
    assert got == {k: "blocked" if k % 2 else "free" for k in range(600)} and len(rounds) <= 30


def test_a_hot_pin_and_an_empty_table(spark):
    units = [(k, ("red ring", "blue", "ring old")[k % 3], 7.0, 80.0) for k in range(3000)] + [(5000, "blue", 7.0 + STEP / 2, 80.0)]
    assert verdicts(spark, units) == walk(units)
    assert verdicts(spark, []) == {}
