"""Greedy claiming of places in order: whoever comes near an earlier claim without a word in common is turned away.

The earliest live unit near a coordinate owns it, and owns it for good. So a unit's verdict depends on its coordinate's owner
and its own words alone, and of the units at one coordinate only the first, and the first with each word, can matter to others.
These candidates are walked in order inside tiles that also see what stands at their border. A tile decides all it can; what
hangs on an undecided neighbour waits for the next round, so the number of rounds is that of the tiles which a chain of
decisions crosses, not that of its units.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelytics.functions import text
from parcelytics.plans.scale import maybe_broadcast, null_safe_join
from parcelytics.session import freeze

#: A tile is this many radii high, cut into `PARTS` by `PARTS` where it holds more candidates than `TILE_CANDIDATES`.
TILE_RADII, PARTS, TILE_CANDIDATES = 64, 16, 20_000
#: Tiles go round the whole globe beyond this latitude.
POLAR = 85.0

_CANDIDATE = ["lat", "lon", "o", "nm"]
_TILE = ["t_row", "t_col", "t_part"]


def _candidates(units: DataFrame) -> DataFrame:
    """Per coordinate its first unit and the first with each distinctive word: lat, lon, o, nm, words."""
    words = F.coalesce(text.distinctive_tokens(F.col("nm")), F.array().cast("array<string>"))
    each = units.select(*_CANDIDATE, F.explode(F.concat(words, F.array(F.lit("")))).alias("word"))
    first = each.groupBy("lat", "lon", "word").agg(F.min(F.struct("o", "nm")).alias("u"))
    return first.select("lat", "lon", "u.o", "u.nm").distinct().withColumn("words", words)


def _tile(lat: Column, lon: Column, reach: float) -> list[Column]:
    """Row and column of the tile of a point, and its part of it; `reach` is the radius in degrees of latitude.

    A column is at least four reaches wide in every part, measured one row nearer to the pole.
    """
    height = min(TILE_RADII * reach, 180.0)
    row = F.floor((lat + 90) / height)
    top = F.greatest(F.abs(row * height - 90), F.abs((row + 1) * height - 90)) + height
    spread = F.degrees(F.asin(F.least(F.lit(math.sin(math.radians(min(reach, 90.0)))) / F.cos(F.radians(F.least(top, F.lit(POLAR)))), F.lit(1.0))))
    fit = F.floor(F.lit(360.0) / (spread * 4 * PARTS))
    columns = F.when((top > POLAR) | (fit < 4), F.lit(1)).otherwise(fit).cast("long")
    across = F.pmod(lon + 180, F.lit(360.0)) / 360 * columns
    column = F.least(F.floor(across), columns - 1)
    inner = F.floor(F.least((lat + 90) / height - row, F.lit(0.9999999)) * PARTS) * PARTS
    part = F.when(columns == 1, inner).otherwise(inner + F.floor(F.least(across - column, F.lit(0.9999999)) * PARTS))
    return [row.cast("long").alias("t_row"), column.cast("long").alias("t_col"), part.cast("int").alias("t_part")]


def _routed(candidates: DataFrame, reach: float) -> DataFrame:
    """Candidates once in their own tile (`own`) and once in each other tile that lies within reach."""
    own = candidates.select("*", *_tile(F.col("lat"), F.col("lon"), reach))
    full = own.groupBy("t_row", "t_col").agg(F.count("*").alias("n")).filter(F.col("n") > TILE_CANDIDATES).select("t_row", "t_col", F.lit(True).alias("cut"))
    sine = F.sin(F.radians(F.lit(min(reach, 90.0)))) / F.cos(F.radians(F.col("lat")))
    aside = F.when(F.abs("lat") + reach >= 90, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(sine, F.lit(1.0)))))
    spots = [(F.col("lat"), F.col("lon"))] + [
        (F.greatest(F.least(F.col("lat") + up * reach, F.lit(90.0)), F.lit(-90.0)), F.col("lon") + side * aside) for up in (-1, 1) for side in (-1, 1)]
    seen = F.array(*[F.struct(F.lit(k == 0).alias("own"), *_tile(lat, lon, reach)) for k, (lat, lon) in enumerate(spots)])
    placed = candidates.select("*", F.explode(seen).alias("t")).select(*candidates.columns, "t.*")
    cut = placed.join(maybe_broadcast(full), ["t_row", "t_col"], "left").withColumn("t_part", F.when(F.col("cut"), F.col("t_part")).otherwise(-1)).drop("cut")
    return cut.groupBy(*_CANDIDATE, *_TILE).agg(F.max("own").alias("own"), F.first("words").alias("words"))


def _walk(frame: pd.DataFrame, reach: float) -> pd.DataFrame:
    """One tile: its own candidates with `live` (None: not yet known) and the claim on their coordinate."""
    keys = ["lat", "lon", "o", "nm", "live", "claim_o", "claim_nm", "settled"]
    if not frame["own"].any():
        return pd.DataFrame(columns=keys)
    rows = sorted(frame.itertuples(index=False), key=lambda r: (r.o, r.nm is not None, r.nm or "", r.lat, r.lon))
    origin = next(r.lon for r in rows if r.own)
    place = lambda lon: (lon - origin + 180) % 360 - 180
    top = max(abs(r.lat) for r in rows) + reach
    wide = 400.0 if top >= 90 else math.degrees(math.asin(min(math.sin(math.radians(reach)) / math.cos(math.radians(top)), 1.0))) * 1.000001
    if wide > 60 or max(place(r.lon) for r in rows) - min(place(r.lon) for r in rows) > 250:
        wide = 1000.0  # a tile around the pole or the globe: cells by latitude alone
    cell = lambda lat, lon: (math.floor(lat / reach), math.floor(place(lon) / wide))
    limit = math.radians(reach)

    def near(a: tuple[float, float], b: tuple[float, float]) -> bool:
        p, q = math.radians(a[0]), math.radians(b[0])
        s, t = math.sin((q - p) / 2), math.sin(math.radians(b[1] - a[1]) / 2)
        return 2 * math.asin(math.sqrt(min(s * s + math.cos(p) * math.cos(q) * t * t, 1.0))) <= limit

    free: dict[tuple[int, int], set[tuple[float, float]]] = {}
    for r in rows:
        if r.own:
            free.setdefault(cell(r.lat, r.lon), set()).add((r.lat, r.lon))
    claims: dict[tuple[float, float], tuple] = {}  # coordinate -> first live or undecided unit near it, and whether it is decided
    out = []
    for r in rows:
        at, live = (r.lat, r.lon), r.live
        if r.own:
            claim = claims.get(at)
            live = True if claim is None else bool(set(claim[0].words) & set(r.words)) if claim[1] else None
            out.append((r, live))
        if live is False:
            continue
        y, x = cell(*at)
        for i in (y - 1, y, y + 1):
            for j in (x - 1, x, x + 1):
                taken = {c for c in free.get((i, j), ()) if c == at or near(at, c)}
                for c in taken:
                    claims[c] = (r, live is not None)
                if taken:
                    free[i, j] -= taken
    return pd.DataFrame([(r.lat, r.lon, r.o, r.nm, live, claims[r.lat, r.lon][0].o, claims[r.lat, r.lon][0].nm, claims[r.lat, r.lon][1])
                         for r, live in out], columns=keys)


def claim_in_order(units: DataFrame, radius_km: float, sphere_km: float) -> DataFrame:
    """`units` (o, nm, lat, lon; o unique) with verdict: free, shared (a word in common with the owner) or blocked.

    A unit without a coordinate is free and claims nothing. A hot coordinate costs one candidate per word used there. A part of a
    tile, four radii high, is walked by one task, which holds its candidates.
    """
    reach = math.degrees(radius_km / sphere_km)
    known = F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon")
    routed = freeze(_routed(_candidates(units.filter(known)), reach))
    kinds = {f.name: f.dataType.simpleString() for f in routed.schema}
    schema = f"lat double, lon double, o {kinds['o']}, nm string, live boolean, claim_o {kinds['o']}, claim_nm string, settled boolean"
    state, todo = None, routed.withColumn("live", F.lit(None).cast("boolean"))
    while True:
        done = freeze(todo.groupBy(*_TILE).applyInPandas(lambda frame: _walk(frame, reach), schema))
        settled = done if state is None else freeze(state.join(done.select(*[F.col(c).alias(f"d_{c}") for c in _CANDIDATE]), _same("d_"), "left_anti").unionByName(done))
        state = settled
        waiting = state.filter("live IS NULL").select(*[F.col(c).alias(f"w_{c}") for c in _CANDIDATE])
        if waiting.isEmpty():
            break
        tiles = routed.filter("own").join(waiting, _same("w_"), "left_semi").select(*_TILE).distinct()
        verdicts = state.select(*[F.col(c).alias(f"s_{c}") for c in _CANDIDATE], "live")
        todo = routed.join(tiles, _TILE, "left_semi").join(verdicts, _same("s_"), "left").drop(*[f"s_{c}" for c in _CANDIDATE])
    owners = state.groupBy("lat", "lon").agg(F.min(F.struct(F.col("claim_o").alias("o"), F.col("claim_nm").alias("nm"))).alias("owner"))
    overlap = F.arrays_overlap(text.distinctive_tokens(F.col("nm")), text.distinctive_tokens(F.col("owner.nm")))
    verdict = F.when(F.col("owner").isNull() | (F.col("owner.o") == F.col("o")), "free").when(overlap, "shared").otherwise("blocked")
    return null_safe_join(units, owners, ["lat", "lon"]).withColumn("verdict", verdict).drop("owner")


def _same(prefix: str) -> Column:
    out = F.lit(True)
    for c in _CANDIDATE:
        out = out & F.col(c).eqNullSafe(F.col(f"{prefix}{c}"))
    return out
