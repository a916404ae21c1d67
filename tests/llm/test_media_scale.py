"""Tiles of images whose samples have another scale than 0 to 255."""

from __future__ import annotations

import io

import numpy as np

from parcelytics.llm import media


def test_tiles_do_not_depend_on_the_scale(spark):
    rng = np.random.default_rng(3)
    grey = rng.integers(0, 256, (20, 30))
    colour = rng.integers(0, 256, (8, 9, 3))
    bits = rng.integers(0, 2, (16, 16))
    plain = lambda kind, a, top: f"P{kind}\n# scale\n{a.shape[1]} {a.shape[0]} {top}\n".encode() + " ".join(map(str, a.ravel())).encode()
    images = {
        "8 bits": media.encode_pgm(grey), "16 bits": b"P5 30 20 65535\n" + (grey * 257).astype(">u2").tobytes(), "text 16 bits": plain(2, grey * 257, 65535),
        "coarse": plain(2, grey // 17, 15), "fine": plain(2, (grey // 17) * 17, 255),
        "colour": plain(3, colour, 255), "colour 16 bits": plain(3, colour * 257, 65535), "bmp": media.encode_bmp(colour.astype(np.uint8)),
        "bits": b"P4 16 16\n" + np.packbits(1 - bits, axis=1).tobytes(), "text bits": b"P1 16 16\n" + " ".join(map(str, (1 - bits).ravel())).encode(), "as grey": media.encode_pgm(bits * 255),
        "top of zero": plain(2, grey * 0, 0), "none": None,
    }
    rows = media.media_columns(spark.createDataFrame(list(images.items()), "k string, media binary")).collect()
    tile = {r["k"]: None if r["tile"] is None else np.load(io.BytesIO(r["tile"])) for r in rows}
    mark = {r["k"]: r["dhash"] for r in rows}
    for same in (("8 bits", "16 bits", "text 16 bits"), ("coarse", "fine"), ("colour", "colour 16 bits", "bmp"), ("bits", "text bits", "as grey")):
        assert all(np.array_equal(tile[same[0]], tile[k]) and mark[same[0]] == mark[k] for k in same[1:]), same
    assert tile["as grey"].max() == 255 and tile["8 bits"].max() > 100 and tile["none"] is None and not tile["top of zero"].any()
