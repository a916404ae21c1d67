"""Media columns: Netpbm and BMP images as numpy arrays, area-resized, kept as NPY tiles with difference hashes."""

from __future__ import annotations

import io
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Samples in a row of the image that holds a payload, and size of the tile that is kept.
WIDTH, TILE = 64, (16, 16)
_HEADER = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*(\d+)")


def encode_pgm(samples: np.ndarray) -> bytes:
    """An 8-bit grey image (rows, columns) in binary form."""
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.astype(np.uint8).tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """A colour image (rows, columns, red-green-blue) of 24 bits a pixel, rows from the bottom."""
    h, w, _ = samples.shape
    rows = np.zeros((h, (w * 3 + 3) // 4 * 4), np.uint8)
    rows[:, : w * 3] = samples[::-1, :, ::-1].reshape(h, w * 3)
    head = struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0)
    return b"BM" + struct.pack("<IHHI", 54 + rows.size, 0, 0, 54) + head + rows.tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    """Samples of P1 to P6: (rows, columns), or (rows, columns, 3) for colour; bits count 1 as black, so 0, and 0 as 1."""
    kind, at, numbers = data[1] - 48, 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        m = _HEADER.match(data, at)
        if not m:
            raise ValueError("the header is cut")
        numbers.append(int(m[1]))
        at = m.end()
    w, h, top = numbers[0], numbers[1], numbers[2] if len(numbers) > 2 else 1
    shape = (h, w, 3) if kind in (3, 6) else (h, w)
    size = int(np.prod(shape))
    if kind == 1:
        bits = np.frombuffer(re.sub(rb"#[^\n\r]*|\s", b"", data[at:])[:size], np.uint8) - 48
        return (1 - bits).reshape(shape).astype(np.uint8)
    if kind in (2, 3):
        values = np.array(re.sub(rb"#[^\n\r]*", b"", data[at:]).split()[:size], np.int64)
        return values.reshape(shape).astype(np.uint8 if top < 256 else np.uint16)
    at += 1  # one white space ends the header
    if kind == 4:
        rows = np.frombuffer(data, np.uint8, (w + 7) // 8 * h, at).reshape(h, -1)
        return 1 - np.unpackbits(rows, axis=1)[:, :w]
    return np.frombuffer(data, np.uint8 if top < 256 else ">u2", size, at).reshape(shape)


def brightest(data: bytes) -> int:
    """The sample value that stands for full brightness: the header's in P2, P3, P5 and P6, 1 for bits, 255 in BMP."""
    if data[:1] != b"P":
        return 255
    if data[1:2] in b"14":
        return 1
    at = 2
    for _ in range(3):
        m = _HEADER.match(data, at)
        at = m.end()
    return max(1, int(m[1]))


def decode_bmp(data: bytes) -> np.ndarray:
    """Pixels of an uncompressed BMP of 8 (with palette), 24 or 32 bits: (rows, columns, red-green-blue)."""
    begin, size, w, h, _, bits, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if packing or bits not in (8, 24, 32):
        raise ValueError(f"BMP of {bits} bits, packing {packing}, isn't supported")
    stride = (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(h), begin).reshape(abs(h), stride)[:, : w * bits // 8]
    if bits == 8:
        palette = np.frombuffer(data, np.uint8, begin - 14 - size, 14 + size).reshape(-1, 4)
        pixels = palette[rows][:, :, 2::-1]
    else:
        pixels = rows.reshape(abs(h), w, bits // 8)[:, :, 2::-1]
    return pixels[::-1] if h > 0 else pixels


def decode(data: bytes | None) -> np.ndarray | None:
    """The image's samples by its first two bytes; None for null and for bytes that are no whole image of these kinds."""
    try:
        if data and data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
            return decode_netpbm(data)
        if data and data[:2] == b"BM":
            return decode_bmp(data)
    except (ValueError, struct.error, IndexError):
        pass
    return None


def grey(image: np.ndarray) -> np.ndarray:
    """Brightness of a colour image by the usual weights; a grey image as it is."""
    return image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])


def area_resize(image: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Mean over the (fractional) area that each new pixel covers, from the image's integral image.

    The integral image is read between its grid points linearly, which is exact for areas. An image without rows or
    columns gives zeros.
    """
    h, w = image.shape[:2]
    if not h or not w:
        return np.zeros((rows, columns))
    total = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(image, axis=0, dtype=float), axis=1, out=total[1:, 1:])
    y, x = np.arange(rows + 1) * (h / rows), np.arange(columns + 1) * (w / columns)
    y0, x0 = np.minimum(y.astype(int), h - 1), np.minimum(x.astype(int), w - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    down = total[y0] * (1 - fy) + total[y0 + 1] * fy
    at = down[:, x0] * (1 - fx) + down[:, x0 + 1] * fx
    return (at[1:, 1:] - at[:-1, 1:] - at[1:, :-1] + at[:-1, :-1]) * (rows * columns / (h * w))


def difference_hash(image: np.ndarray) -> str:
    """64 bits as hex: whether each pixel of an 8 x 9 reduction is darker than its right neighbour."""
    small = np.round(area_resize(image, 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(array), version=(1, 0))
    return out.getvalue()


def tile_of(image: np.ndarray, size: tuple[int, int] = TILE) -> np.ndarray:
    return np.clip(np.round(area_resize(image, *size)), 0, 255).astype(np.uint8)


def media_columns(df: DataFrame, media: str = "media", size: tuple[int, int] = TILE) -> DataFrame:
    """`df` with height, width, tile (NPY bytes) and dhash of each image in `media`.

    Tiles hold brightness from 0 to 255, whatever the image's own scale. Null bytes, and bytes that are no image of the known kinds
    or are cut short, give nulls; equal images give equal values. Columns with these names are replaced, others stay; an empty table gives no rows. An image of any size is
    held once per task.
    """

    @F.pandas_udf("height int, width int, tile binary, dhash string")
    def described(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for data in batch:
                image = decode(data)
                if image is None:
                    rows.append((None, None, None, None))
                else:
                    g = grey(image) * (255 / brightest(data))
                    rows.append((image.shape[0], image.shape[1], npy(tile_of(g, size)), difference_hash(g)))
            yield pd.DataFrame(rows, columns=["height", "width", "tile", "dhash"]).astype({"height": "Int32", "width": "Int32"})

    return df.withColumn("__m", described(F.col(media))).select(
        *[c for c in df.columns if c not in ("height", "width", "tile", "dhash")], "__m.height", "__m.width", "__m.tile", "__m.dhash"
    )


def stored_texts(df: DataFrame, text: str = "text", size: tuple[int, int] = TILE) -> DataFrame:
    """`df` with its texts as images: n_bytes, media (a grey image), payload (read back from it), tile and dhash.

    The payload is the text in UTF-8 (null: empty) with zero bytes up to a positive multiple of 64, one sample a byte.
    """

    @F.pandas_udf("n_bytes long, media binary, payload binary, tile binary, dhash string")
    def stored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                rows = []
                for t in batch.iloc[at : at + 500]:
                    raw = (t or "").encode("utf-8", "replace")
                    padded = raw.ljust(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH), b"\0")
                    media = encode_pgm(np.frombuffer(padded, np.uint8).reshape(-1, WIDTH))
                    image = decode(media)
                    rows.append((len(raw), media, image.tobytes(), npy(tile_of(image, size)), difference_hash(image)))
                yield pd.DataFrame(rows, columns=["n_bytes", "media", "payload", "tile", "dhash"])

    own = ("n_bytes", "media", "payload", "tile", "dhash")
    return df.withColumn("__m", stored(F.col(text))).select(*[c for c in df.columns if c not in own], *[F.col(f"__m.{c}").alias(c) for c in own])
