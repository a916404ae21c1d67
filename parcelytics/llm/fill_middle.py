"""Fill-in-middle: texts cut into prefix, middle and suffix, their blocks exchanged in place by three reversals, and put back exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks before prefix, suffix and middle. No mark's end begins another, so the first occurrence in an output is the inserted one.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of 100 texts, so many are transformed, and of 100 transformed ones so many have the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
#: Bytes that a reversal copies at a time, and rows whose outputs a task holds at a time.
_SWAP, _ROWS = 1 << 16, 500


def draws(key: str, seed: int = 1) -> list[Column]:
    """Four numbers below 2^32 from the SHA-256 of seed and key (null counts as empty): the same in every run and order of rows."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def reverse(buffer: bytearray, a: int, b: int) -> None:
    """Reverse buffer[a:b] in place, exchanging pieces of bounded size from both ends."""
    while b - a > 2 * _SWAP:
        head = buffer[a : a + _SWAP]
        buffer[a : a + _SWAP] = buffer[b - _SWAP : b][::-1]
        buffer[b - _SWAP : b] = head[::-1]
        a, b = a + _SWAP, b - _SWAP
    buffer[a:b] = buffer[a:b][::-1]


def rotate(buffer: bytearray, a: int, mid: int, b: int) -> None:
    """Exchange the blocks buffer[a:mid] and buffer[mid:b] in place: each is reversed, then both together.

    `rotate(buffer, a, a + b - mid, b)` undoes it.
    """
    reverse(buffer, a, mid)
    reverse(buffer, mid, b)
    reverse(buffer, a, b)


def unit_starts(data: bytes) -> np.ndarray:
    """Byte offsets at which the units of a UTF-8 text begin: runs of ASCII letters, and every other code point."""
    codes = np.frombuffer(data, np.uint8)
    letter = ((codes | 32) - 97).astype(np.uint8) < 26
    start = (codes & 0xC0) != 0x80
    start[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(start)


def code_points(data: bytes | bytearray, a: int, b: int) -> int:
    return int(np.count_nonzero((np.frombuffer(data, np.uint8, b - a, a) & 0xC0) != 0x80))


def transform_text(data: bytes, h: tuple[int, int, int, int]) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of prefix and middle, output) of one text in UTF-8 under four draws."""
    starts = unit_starts(data)
    n = len(starts)
    if not data or PREFIX in data or SUFFIX in data or MIDDLE in data or h[2] % 100 >= TRANSFORMED:
        return n, "plain", None, None, data
    a, b = (int(starts[k]) if k < n else len(data) for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    buffer = bytearray(data)
    buffer[b:b] = SUFFIX
    buffer[a:a] = MIDDLE
    buffer[0:0] = PREFIX
    a, b, end = a + len(PREFIX), b + len(PREFIX) + len(MIDDLE), len(buffer)  # where the marks of middle and suffix stand
    chars = code_points(buffer, len(PREFIX), a), code_points(buffer, a + len(MIDDLE), b)
    if h[3] % 100 < SUFFIX_FIRST:
        rotate(buffer, 0, b, end)  # P prefix M middle | S suffix
        return n, "spm", *chars, bytes(buffer)
    rotate(buffer, a, b, end)  # P prefix, then M middle | S suffix
    return n, "psm", *chars, bytes(buffer)


def restore_text(output: bytes, form: str) -> bytes:
    """The text that `transform_text` was given, from its output and form alone: the rotation undone, the marks taken out."""
    if form == "plain":
        return output
    buffer = bytearray(output)
    end = len(buffer)
    if form == "psm":
        a = buffer.index(SUFFIX)
        middle = buffer.index(MIDDLE, a)
        rotate(buffer, a, middle, end)
        b = a + end - middle
    else:
        prefix = buffer.index(PREFIX)
        rotate(buffer, 0, prefix, end)
        a, b = buffer.index(MIDDLE), end - prefix
    del buffer[b : b + len(SUFFIX)]
    del buffer[a : a + len(MIDDLE)]
    del buffer[: len(PREFIX)]
    return bytes(buffer)


def transform(df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1) -> DataFrame:
    """`df` with n (units), form (plain, psm or spm), prefix_chars, middle_chars and output of each whole text.

    Cuts and form follow from a hash of the key, so they don't depend on the order or place of rows. A null text counts as
    empty; an empty text, and one that holds a mark already, stay plain. A null key is hashed as empty; rows of the same key
    and text get equal results, rows of the same key and other texts the same draws. An empty table gives no rows. Columns
    with the names of results are replaced, others stay. A very long text is held once with its output; no text is cut off.
    """

    @F.pandas_udf("n long, form string, prefix_chars long, middle_chars long, output binary")
    def transformed(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch[0]), _ROWS):
                texts, *h = (column.iloc[at : at + _ROWS] for column in batch)
                rows = [transform_text(t or b"", draw) for t, draw in zip(texts, zip(*h))]
                out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
                yield out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    own = ("n", "form", "prefix_chars", "middle_chars", "output")
    done = df.withColumn("__fim", transformed(F.col(text).cast("binary"), *draws(key, seed)))
    return done.select(
        *[c for c in df.columns if c not in own], *[F.col(f"__fim.{c}").alias(c) for c in own[:-1]], F.col("__fim.output").cast("string").alias("output")
    )


def restore(df: DataFrame, output: str = "output", form: str = "form", out: str = "restored") -> DataFrame:
    """`df` with the text of each row rebuilt from its output and form; nulls give null, a column called like `out` is replaced."""

    @F.pandas_udf("binary")
    def restored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for outputs, forms in batches:
            for at in range(0, len(outputs), _ROWS):
                pairs = zip(outputs.iloc[at : at + _ROWS], forms.iloc[at : at + _ROWS])
                yield pd.Series([None if o is None or f is None else restore_text(o, f) for o, f in pairs], dtype=object)

    return df.withColumn(out, restored(F.col(output).cast("binary"), F.col(form)).cast("string"))
