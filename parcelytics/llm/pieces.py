"""SentencePiece BPE encoding and decoding by vectorised merge rounds over flat numpy symbol arrays."""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Word segments that a task remembers with their ids; beyond that it forgets all and starts anew.
CACHE_WORDS = 300_000
#: Characters whose segments are held at a time.
_PORTION = 500_000
#: Symbols from which a word whose merges meet is finished by a queue.
_QUEUED = 64
_NO_RANK = np.int64(2**40)
_SEGMENT = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


def _segments(text: str) -> list[str]:
    """Parts of a text that no piece goes beyond; an empty part has no ids."""
    if not text:
        return []
    if SPACE in text or "  " in text or text[0] == " ":
        return _SEGMENT.findall(SPACE + text.replace(" ", SPACE))
    return (SPACE + text.replace(" ", " " + SPACE).replace("\n", " \n ")).split(" ")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of one protobuf message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 5:
            value, at = struct.unpack_from("<f", data, at)[0], at + 4
        elif kind == 1:
            value, at = struct.unpack_from("<d", data, at)[0], at + 8
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind} in the model file")
        yield tag >> 3, value


class PieceModel:
    """A BPE model with byte fallback: tables for merging, and the words encoded so far."""

    # kinds of pieces in the model format
    NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

    def __init__(self, data: bytes):
        pieces, normalizer, trainer = [], {3: 1, 4: 1, 5: 1}, {}
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                pieces.append((own[1].decode(), own.get(2, 0.0), own.get(3, self.NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer |= dict(_fields(value))
        kinds = {k for _, _, k in pieces}
        if trainer.get(3) != 2 or normalizer.get(2) or normalizer[4] or not normalizer[3] or not normalizer[5] or kinds & {self.USER_DEFINED, self.UNUSED} or self.BYTE not in kinds:
            raise ValueError("this model needs another form of normalisation or merging")
        self.size = len(pieces)
        self.unknown = next(i for i, p in enumerate(pieces) if p[2] == self.UNKNOWN)
        named = {p[0]: i for i, p in enumerate(pieces)}
        self.begin, self.end = named["<s>"], named["</s>"]
        self.byte_ids = np.zeros(256, np.int64)
        self.surface: list[bytes] = []
        self.is_byte, self.is_control = np.zeros(self.size, bool), np.zeros(self.size, bool)
        ids = {}
        for i, (piece, _, kind) in enumerate(pieces):
            if kind == self.NORMAL:
                ids[piece] = i
                if SPACE in piece.lstrip(SPACE) or "\n" in piece:
                    raise ValueError("a piece goes beyond one segment")
                self.surface.append(piece.replace(SPACE, " ").encode())
            elif kind == self.BYTE:
                self.byte_ids[int(piece[3:5], 16)] = i
                self.is_byte[i] = True
                self.surface.append(bytes([int(piece[3:5], 16)]))
            else:
                self.is_control[i] = kind == self.CONTROL
                self.surface.append(b"" if kind == self.CONTROL else " ⁇ ".encode())
        self.starts_with_space = np.array([s.startswith(b" ") and not b and k != self.UNKNOWN for s, b, k in zip(self.surface, self.is_byte, (p[2] for p in pieces))])
        self.surface_size = np.array([len(s) for s in self.surface])
        self.surface_at = np.concatenate([[0], np.cumsum(self.surface_size)[:-1]])
        self.surface_bytes = np.frombuffer(b"".join(self.surface), np.uint8)
        single = sorted((ord(p), i) for p, i in ids.items() if len(p) == 1)
        self.chars, self.char_ids = np.array([c for c, _ in single]), np.array([i for _, i in single])
        # every way to make a piece of two pieces; the better the score, the lower the rank, equal scores share one
        scores = sorted({pieces[i][1] for i in ids.values()}, reverse=True)
        rank_of = {s: r for r, s in enumerate(scores)}
        rows = sorted(
            (ids[p[:k]] * self.size + ids[p[k:]], rank_of[pieces[i][1]], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids
        )
        self.pair, self.pair_rank, self.pair_id = (np.array(x, np.int64) for x in zip(*rows))
        self.merges = {k: (r, i) for k, r, i in rows}
        self.cache: dict[str, bytes] = {}

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of pairs of symbols; no rank where they make no piece."""
        rank, merged = np.full(len(a), _NO_RANK), np.zeros(len(a), np.int64)
        near = np.flatnonzero((a >= 0) & (b >= 0))
        key = a[near] * self.size + b[near]
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        hit = self.pair[at] == key
        near, at = near[hit], at[hit]
        rank[near], merged[near] = self.pair_rank[at], self.pair_id[at]
        return rank, merged

    def _with_right(self, symbols: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """_ranks() of the symbols at the given places with their right neighbours in the same word."""
        after = np.minimum(at + 1, len(symbols) - 1)
        inside = (at + 1 < len(symbols)) & (word[after] == word[at])
        return self._ranks(symbols[at], np.where(inside, symbols[after], -1))

    def _merge(self, symbols, word, rank, merged, chosen):
        """The arrays after the merges at `chosen`; only pairs beside them are looked up anew."""
        stay = np.ones(len(symbols), bool)
        stay[chosen + 1] = False
        symbols = symbols.copy()
        symbols[chosen] = merged[chosen]
        symbols, word, rank, merged = symbols[stay], word[stay], rank[stay], merged[stay]
        at = (np.cumsum(stay) - 1)[chosen]
        at = np.concatenate([at, at[at > 0] - 1])
        rank[at], merged[at] = self._with_right(symbols, word, at)
        return symbols, word, rank, merged

    def _queue(self, symbols: list[int]) -> list[int]:
        """Merges of one word by a queue: best score first, then leftmost."""
        n = len(symbols)
        left, right, gone = list(range(-1, n - 1)), [*range(1, n), -1], [False] * n
        heap: list[tuple[int, int, int, int, int]] = []

        def add(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and symbols[i] >= 0 and symbols[j] >= 0 and (hit := self.merges.get(symbols[i] * self.size + symbols[j])):
                heapq.heappush(heap, (hit[0], i, symbols[i], symbols[j], hit[1]))

        for i in range(n - 1):
            add(i, i + 1)
        while heap:
            _, i, a, b, into = heapq.heappop(heap)
            j = right[i]
            if gone[i] or j < 0 or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], gone[j], right[i] = into, True, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            add(left[i], i)
            add(i, right[i])
        return [s for s, g in zip(symbols, gone) if not g]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of segments as little-endian unsigned 32-bit integers.

        A round merges, in every word at once, the leftmost occurrences of the word's best pair; a word where a merge
        makes a pair that goes before (or ties with) the occurrences still open merges only the first, as a queue would
        (a long one, such as a long run of blanks, is finished by such a queue). Words without a pair leave the arrays.
        """
        if not any(words):
            return [b""] * len(words)
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        at = np.minimum(np.searchsorted(self.chars, codes), len(self.chars) - 1)
        symbols = np.where(self.chars[at] == codes, self.char_ids[at], -codes - 1)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, merged = self._with_right(symbols, word, np.arange(len(symbols)))
        while len(symbols):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(symbols)))
            live = np.repeat(best < _NO_RANK, size)
            if not live.all():
                done.append((symbols[~live], word[~live]))
                symbols, word, rank, merged = symbols[live], word[live], rank[live], merged[live]
                size, best = size[best < _NO_RANK], best[best < _NO_RANK]
                continue
            of_word = np.repeat(best, size)
            hits = np.flatnonzero(rank == of_word)
            # in a run of neighbouring hits every other one is free to merge
            start = np.concatenate([[True], np.diff(hits) != 1])
            begin = hits[start][np.cumsum(start) - 1]
            chosen = hits[(hits - begin) % 2 == 0]
            new = self._merge(symbols, word, rank, merged, chosen)
            new_first = np.flatnonzero(np.concatenate([[True], new[1][1:] != new[1][:-1]]))
            early = np.minimum.reduceat(new[2], new_first) <= best
            # what a merge would have met before its right neighbour merged, too
            close = chosen[:-1][(np.diff(chosen) == 2) & (word[chosen[:-1]] == word[chosen[1:]])]
            if len(close):
                met, _ = self._ranks(merged[close], symbols[close + 2])
                index = np.repeat(np.arange(len(size)), size)[close]
                np.logical_or.at(early, index, met <= best[index])
            if early.any():
                queued = early & (size > _QUEUED)
                if queued.any():
                    ends = np.cumsum(size)
                    for w in np.flatnonzero(queued):
                        own = slice(ends[w] - size[w], ends[w])
                        found = self._queue(symbols[own].tolist())
                        done.append((np.array(found, np.int64), np.full(len(found), word[own.start])))
                    stay = np.repeat(~queued, size)
                    symbols, word, rank, merged = symbols[stay], word[stay], rank[stay], merged[stay]
                    continue
                bad = np.repeat(early, size)[chosen]
                owner = word[chosen]
                leading = np.concatenate([[True], owner[1:] != owner[:-1]])
                if (bad & ~leading).any():
                    new = self._merge(symbols, word, rank, merged, chosen[~bad | leading])
            symbols, word, rank, merged = new
        symbols, word = np.concatenate([s for s, _ in done] or [symbols]), np.concatenate([w for _, w in done] or [word])
        order = np.argsort(word, kind="stable")
        symbols, word = symbols[order], word[order]
        odd = np.flatnonzero(symbols < 0)
        if len(odd):  # characters without a piece become their bytes
            spelled = [chr(-s - 1).encode("utf-8", "replace") for s in symbols[odd]]
            times = np.ones(len(symbols), np.int64)
            times[odd] = [len(x) for x in spelled]
            symbols, word, was = np.repeat(symbols, times), np.repeat(word, times), np.repeat(symbols < 0, times)
            symbols[was] = self.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
        flat = symbols.astype("<u4").tobytes()
        ends = np.searchsorted(word, np.arange(len(words)), side="right") * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, with the begin and end ids."""
        begin, end = (int(i).to_bytes(4, "little") for i in (self.begin, self.end))
        cut = [_segments(t) for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        missing = list(set().union(*cut).difference(self.cache))
        if missing:
            self.cache.update(zip(missing, self.encode_words(missing)))
        get = self.cache.__getitem__
        return [begin + b"".join(map(get, words)) + end for words in cut]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids as the library gives it; ids outside the vocabulary are refused."""
        ids = ids.astype(np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("an id is outside the vocabulary")
        plain = np.flatnonzero(~self.is_control[ids])
        if not len(plain):
            return ""
        ids = ids[plain[0] : plain[-1] + 1]
        if len(plain) != len(ids):
            return self._decode_broken(ids)[int(self.starts_with_space[ids[0]]) :]
        sizes = self.surface_size[ids]
        ends = np.cumsum(sizes)
        flat = self.surface_bytes[np.arange(ends[-1]) + np.repeat(self.surface_at[ids] - (ends - sizes), sizes)].tobytes()
        skip = int(self.starts_with_space[ids[0]])  # the blank that encoding puts before a text
        try:
            return flat[skip:].decode()
        except UnicodeDecodeError:
            return self._decode_broken(ids)[skip:]

    def _decode_broken(self, ids: np.ndarray) -> str:
        """As decode() where byte pieces aren't UTF-8 or control ids part them: a byte that starts no character is U+FFFD."""
        out, run = [], bytearray()

        def flush():
            at = 0
            while at < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[at : at + n]).decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    n = 1
                at += n
            run.clear()

        for i in ids.tolist():
            if self.is_byte[i]:
                run += self.surface[i]
            else:
                flush()
                out.append(self.surface[i].decode())
        flush()
        return "".join(out)


_LOADED: dict[bytes, PieceModel] = {}


def _model(shared) -> PieceModel:
    """The model of a broadcast file, built once in a worker."""
    data = shared.value
    if data not in _LOADED:
        _LOADED[data] = PieceModel(data)
    return _LOADED[data]


def _shared(df: DataFrame, model_path: str):
    """The model file, half a megabyte whatever the table, for every task."""
    with open(model_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _portions(texts: pd.Series) -> Iterator[list[str]]:
    """The texts of a batch, null as empty, in lists of a bounded number of characters (or one longer text)."""
    held, size = [], 0
    for text in texts:
        text = text or ""
        if held and size + len(text) > _PORTION:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def encode(df: DataFrame, model_path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """`df` with the token ids of each whole text, as binary: little-endian unsigned 32-bit integers.

    The ids are those of the sentencepiece library, begin and end ids included. Null counts as the empty text, whose ids
    are the begin and end ids alone. Equal texts get equal ids, an empty table gives no rows, a column called like `out`
    is replaced, all other columns stay as they are. A very long text is held once with its ids; no text is cut.
    """
    shared = _shared(df, model_path)

    @F.pandas_udf("binary")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _model(shared)
        for batch in batches:
            for texts in _portions(batch):
                yield pd.Series(model.encode(texts), dtype=object)

    return df.withColumn(out, ids(F.col(text)))


def decode(df: DataFrame, model_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`df` with the text of each row's ids (binary as of `encode`); null ids give null."""
    shared = _shared(df, model_path)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _model(shared)
        for batch in batches:
            yield pd.Series([None if x is None else model.decode(np.frombuffer(x, "<u4")) for x in batch], dtype=object)

    return df.withColumn(out, text(F.col(ids)))


def encode_decode(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """`df` with the ids of each text and the text decoded from them, in one pass: `encode` and `decode` in one worker."""
    shared = _shared(df, model_path)

    @F.pandas_udf("ids binary, decoded string")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = _model(shared)
        for batch in batches:
            for texts in _portions(batch):
                found = model.encode(texts)
                yield pd.DataFrame({"ids": found, "decoded": [model.decode(np.frombuffer(x, "<u4")) for x in found]})

    return df.withColumn("__both", both(F.col(text))).withColumn(ids, F.col("__both.ids")).withColumn(decoded, F.col("__both.decoded")).drop("__both")


def n_tokens(ids: str = "ids"):
    """Number of ids in a binary column."""
    return (F.octet_length(ids) / 4).cast("long")
