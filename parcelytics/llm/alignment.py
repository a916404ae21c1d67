"""Cross-tokenizer alignment: fragments of byte ranges compose as a monoid, so very long texts are aligned by many tasks and a tree of unions."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelytics.session import freeze

#: Texts of more bytes are cut into ranges of RANGE bytes; a range reads at most CONTEXT bytes more at each end; fragments united at a time.
LONG, RANGE, CONTEXT, FAN = 64 << 10, 32 << 10, 4 << 10, 8
#: Bytes of text whose tokens a task holds at a time (or one longer unit), and bytes of links that it counts at a time.
_PORTION, _LINKS = 1 << 18, 1 << 22

# How byte-level vocabularies cut texts before their merges, and the bytes that their entries write as themselves.
_PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]

# A space between two characters that are surely no white space. There both vocabularies begin a token, and what stands before has no
# influence on what follows. Lead bytes C2 and E1 to E3 begin all white space outside ASCII, so their characters aren't taken.
_CUT = re.compile(
    rb"(?:(?<=[!-~])|(?<=[\xC3-\xDF][\x80-\xBF])|(?<=[\xE0\xE4-\xEE][\x80-\xBF]{2})|(?<=[\xF0-\xF4][\x80-\xBF]{3})) (?=[!-~\xC3-\xE0\xE4-\xEE\xF0-\xF4])"
)


class Vocabulary:
    """Bytes of every token id, their lengths, and the ids in decimal."""

    def __init__(self, surfaces: list[bytes]):
        self.length = np.array([len(s) for s in surfaces], np.int64)
        self.flat = np.frombuffer(b"".join(surfaces), np.uint8)
        self.begin = np.cumsum(self.length) - self.length
        self.digits = np.array([len(str(i)) for i in range(len(surfaces))], np.int64)
        self.decimal = np.frombuffer(b"".join(str(i).encode().ljust(self.digits[-1] + 1, b"\0") for i in range(len(surfaces))), np.uint8)
        self.decimal = self.decimal.reshape(len(surfaces), -1)
        self.surfaces = surfaces

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a run of tokens."""
        size = self.length[ids]
        return self.flat[np.repeat(self.begin[ids] - np.cumsum(size) + size, size) + np.arange(size.sum())]


class ByteLevel(Vocabulary):
    """A byte-level BPE vocabulary (the JSON file of a tokenizer), without special tokens: their strings are plain text."""

    def __init__(self, data: bytes):
        model = json.loads(data)["model"]
        shown = {chr(b): b for b in _PLAIN}
        shown |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(_PLAIN))}
        ranks = {bytes(shown[c] for c in entry): i for entry, i in model["vocab"].items()}
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if any(a >= b for a, b in zip(merged, merged[1:])):
            raise ValueError("the order of merges isn't that of the ids")
        super().__init__([s for s, _ in sorted(ranks.items(), key=lambda x: x[1])])
        self._encoding = tiktoken.Encoding("bytes", pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={})

    def encode(self, units: list[bytes]) -> list[list[int]]:
        return [self._encoding.encode_ordinary(u.decode()) for u in units]


class Pieces(Vocabulary):
    """A sentencepiece model; it writes a space before a text itself, so units come without their first byte, a space."""

    def __init__(self, data: bytes):
        self._model = model = sentencepiece.SentencePieceProcessor(model_proto=data)

        def surface(i: int) -> bytes:
            if model.is_byte(i):
                return bytes([int(model.id_to_piece(i)[3:-1], 16)])
            return b"" if model.is_control(i) or model.is_unknown(i) else model.id_to_piece(i).replace("▁", " ").encode()

        super().__init__([surface(i) for i in range(model.get_piece_size())])

    def encode(self, units: list[bytes]) -> list[list[int]]:
        return self._model.encode([u[1:].decode() for u in units], num_threads=1)


@dataclass
class Fragment:
    """What the tokens that end in one byte range say: ids up to the first common end, groups closed between, ids after the last common end.

    Without a common end all ids stand in the heads. `closed` lists whole groups, `links` the pairs of ids at common ends.
    """

    ok: bool = True
    n_a: int = 0
    n_b: int = 0
    cuts: int = 0
    head_a: bytes = b""
    head_b: bytes = b""
    closed: bytes = b""
    tail_a: bytes = b""
    tail_b: bytes = b""
    links: bytes = b""


_FIELDS = "ok boolean, n_a long, n_b long, cuts long, head_a binary, head_b binary, closed binary, tail_a binary, tail_b binary, links binary"


def group_text(a: bytes, b: bytes) -> bytes:
    """One group of ids (unsigned 32-bit integers): `1,2|3`."""
    return b"|".join(b",".join(b"%d" % i for i in np.frombuffer(side, "<u4")) for side in (a, b))


def _listed(*groups: bytes) -> bytes:
    return b";".join(g for g in groups if g)


def union(x: Fragment, y: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges; associative, with the empty fragment as neutral element."""
    both = (x.ok and y.ok, x.n_a + y.n_a, x.n_b + y.n_b, x.cuts + y.cuts)
    links = x.links + y.links
    if not x.cuts:
        return Fragment(*both, x.head_a + y.head_a, x.head_b + y.head_b, y.closed, y.tail_a, y.tail_b, links)
    if not y.cuts:
        return Fragment(*both, x.head_a, x.head_b, x.closed, x.tail_a + y.head_a, x.tail_b + y.head_b, links)
    middle = group_text(x.tail_a + y.head_a, x.tail_b + y.head_b)
    return Fragment(*both, x.head_a, x.head_b, _listed(x.closed, middle, y.closed), y.tail_a, y.tail_b, links)


def finished(f: Fragment) -> tuple[int, int, bytes, bytes]:
    """(tokens of a, tokens of b, groups, links) of a whole text; nothing where its bytes weren't met."""
    if not f.ok or not f.cuts:
        return 0, 0, b"", b""
    return f.n_a, f.n_b, _listed(group_text(f.head_a, f.head_b), f.closed), f.links


def ranges(full: bytes) -> Iterator[tuple[bytes, int, int]]:
    """(unit, begin, end): what to tokenize for each byte range of a long text (a space first), and where the range lies in it.

    Ranges end at multiples of RANGE bytes, in the midst of words too. The unit reaches from the last place before to the first
    after the range where the text may be cut without changing tokens; a multiple without such places near joins its two ranges.
    """
    left, begin = 0, 0
    for at in range(RANGE, len(full), RANGE):
        near = list(_CUT.finditer(full, max(begin + 1, at - CONTEXT), at + 2))
        before = near[-1].start() if near else -1
        after = _CUT.search(full, at, at + CONTEXT)
        if before >= 0 and after:
            yield full[left : after.start()], begin - left, at - left
            left, begin = before, at
    yield full[left:], begin - left, len(full) - left


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def fragments(a: Vocabulary, b: Vocabulary, units: list[tuple[bytes, int, int]]) -> list[Fragment]:
    """The fragments of units (bytes that begin with a space, begin and end of the range in them), for all units at once."""
    bodies = [u for u, _, _ in units]
    tokens = [[np.array(ids, np.int64) for ids in side.encode(bodies)] for side in (a, b)]
    size = np.array([len(u) for u in bodies], np.int64)
    ok = np.ones(len(units), bool)
    for side, ids in zip((a, b), tokens):
        ok &= np.array([side.length[i].sum() for i in ids], np.int64) == size
        ok &= [bool(o) and side.joined(i).tobytes() == u for o, i, u in zip(ok, ids, bodies)]
    good = np.flatnonzero(ok)
    out = [Fragment(ok=False) for _ in units]
    if not len(good):
        return out
    base = _offsets(size[good])
    lo, hi = (base[:-1] + np.array([units[u][k] for u in good]) for k in (1, 2))
    sides = []
    for side, all_ids in zip((a, b), tokens):
        ids = np.concatenate([all_ids[u] for u in good])
        unit = np.repeat(np.arange(len(good)), [len(all_ids[u]) for u in good])
        end = np.cumsum(side.length[ids])
        inside = (end > lo[unit]) & (end <= hi[unit])
        sides.append((ids, unit, end, inside))
    common = np.ones(base[-1] + 1, bool)
    for _, _, end, _ in sides:
        seen = np.zeros(len(common), bool)
        seen[end] = True
        common &= seen
    ids, unit, group, last = [], [], [], []
    for i, u, end, inside in sides:
        i, u, cut = i[inside], u[inside], common[end[inside]]
        ids.append(i)
        unit.append(u)
        last.append(cut)
        group.append(np.cumsum(cut) - cut + u)  # each unit has a number more than it has common ends, for what follows the last one
    (ids_a, ids_b), (group_a, group_b), (cut_a, cut_b) = ids, group, last
    text, byte_at = _all_groups(a, b, ids_a, ids_b, group_a, group_b)
    n = np.arange(len(good) + 1)
    at_a, at_b = np.searchsorted(unit[0], n), np.searchsorted(unit[1], n)
    cuts = _offsets(cut_a)[at_a]
    pairs = np.stack([ids_a[cut_a], ids_b[cut_b]], 1).astype("<u4")
    raw_a, raw_b = ids_a.astype("<u4"), ids_b.astype("<u4")
    for k, u in enumerate(good):
        first, count = cuts[k] + k, cuts[k + 1] - cuts[k]
        a0, a1, b0, b1 = at_a[k], at_a[k + 1], at_b[k], at_b[k + 1]
        head_a, head_b = np.searchsorted(group_a[a0:a1], first, "right") + a0, np.searchsorted(group_b[b0:b1], first, "right") + b0
        tail_a = max(head_a, np.searchsorted(group_a[a0:a1], first + count) + a0)
        tail_b = max(head_b, np.searchsorted(group_b[b0:b1], first + count) + b0)
        closed = text[byte_at[head_a + head_b] : byte_at[tail_a + tail_b]].tobytes()[:-1]
        out[u] = Fragment(
            True, int(a1 - a0), int(b1 - b0), int(count), raw_a[a0:head_a].tobytes(), raw_b[b0:head_b].tobytes(), closed,
            raw_a[tail_a:a1].tobytes(), raw_b[tail_b:b1].tobytes(), pairs[cuts[k] : cuts[k + 1]].tobytes(),
        )
    return out


def _all_groups(a: Vocabulary, b: Vocabulary, ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray):
    """The text of all groups, `1,2|3;` each, and where the text of each token begins, tokens in order of group and side."""
    place = (np.arange(len(ids_a)) + np.searchsorted(group_b, group_a, "left"), np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, "right"))
    n = len(ids_a) + len(ids_b)
    width = max(a.decimal.shape[1], b.decimal.shape[1])
    shown, size = np.zeros((n, width), np.uint8), np.zeros(n, np.int64)
    for side, ids, group, at, end in ((a, ids_a, group_a, place[0], b"|"), (b, ids_b, group_b, place[1], b";")):
        shown[at, : side.decimal.shape[1]] = side.decimal[ids]
        size[at] = side.digits[ids]
        closes = np.append(group[1:] != group[:-1], True) if len(group) else np.empty(0, bool)
        shown[at, side.digits[ids]] = np.where(closes, end[0], ord(","))
    return shown[np.arange(width) <= size[:, None]], _offsets(size + 1)


_LOADED: dict[tuple[bytes, bytes], tuple[ByteLevel, Pieces]] = {}


def _models(shared) -> tuple[ByteLevel, Pieces]:
    """Both vocabularies of broadcast files, built once in a worker."""
    if shared.value not in _LOADED:
        _LOADED[shared.value] = ByteLevel(shared.value[0]), Pieces(shared.value[1])
    return _LOADED[shared.value]


def _portions(units: Iterator[tuple], limit: int = _PORTION) -> Iterator[list[tuple]]:
    """Tuples (unit first) in lists of a bounded number of bytes, or of one longer unit."""
    held, size = [], 0
    for x in units:
        if held and size + len(x[0]) > limit:
            yield held
            held, size = [], 0
        held.append(x)
        size += len(x[0])
    if held:
        yield held


def _long_texts(rows: DataFrame, text: str, shared) -> DataFrame:
    """(__row, n_a, n_b, groups, links) of long texts: their ranges dealt over the tasks, fragments united in a tree."""

    names = list(Fragment.__dataclass_fields__)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, body in zip(batch["__row"], batch["__text"]):
                for k, (unit, begin, end) in enumerate(ranges(b" " + body)):
                    yield pd.DataFrame({"__row": [row], "seq": [k], "unit": [unit], "begin": [begin], "end": [end]})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = _models(shared)
        for batch in batches:
            for held in _portions(zip(batch["unit"], batch["begin"], batch["end"], batch["__row"], batch["seq"])):
                out = pd.DataFrame([astuple(f) for f in fragments(a, b, [h[:3] for h in held])], columns=names)
                yield out.assign(__row=[h[3] for h in held], seq=[h[4] for h in held])

    def total(group: pd.DataFrame) -> Fragment:
        out = Fragment()
        for values in group.sort_values("seq")[names].itertuples(index=False):
            out = union(out, Fragment(*values))
        return out

    def unite(group: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame([astuple(total(group))], columns=names)
        return out.assign(__row=group["__row"].iloc[0], seq=group["seq"].iloc[0] // FAN)

    def finish(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(group["__row"].iloc[0], *finished(total(group)))], columns=["__row", "n_a", "n_b", "groups", "links"])

    longest = rows.agg(F.max(F.octet_length(text)).alias("n")).first()["n"]
    found = rows.select("__row", F.col(text).cast("binary").alias("__text")).mapInPandas(cut, "__row long, seq long, unit binary, begin long, end long")
    found = found.repartition("__row", "seq").mapInPandas(read, f"__row long, seq long, {_FIELDS}")
    count = longest // RANGE + 1
    while count > FAN:
        found = found.groupBy("__row", F.floor(F.col("seq") / FAN).alias("__to")).applyInPandas(unite, f"__row long, seq long, {_FIELDS}")
        count = -(-count // FAN)
    return found.groupBy("__row").applyInPandas(finish, "__row long, n_a long, n_b long, groups binary, links binary")


def align(df: DataFrame, byte_level: str, pieces: str, text: str = "text") -> DataFrame:
    """`df` with n_a, n_b, groups and links of each whole text, encoded by a byte-level vocabulary (a) and a sentencepiece model (b).

    `byte_level` and `pieces` are paths of the files on the driver. a reads a space and the text, b the text (it writes the space itself), both
    without special tokens. Tokens are cut into groups where tokens of a and b end at the same byte: `a1,a2|b1;a3|b2,b3`. A link is
    the pair of the two tokens that end there; `links` holds the pairs of ids as little-endian unsigned 32-bit integers.
    Null and empty texts, and texts whose tokens don't give back the bytes of space and text, have no tokens: zeros, empty
    groups and links. Equal texts get equal values, an empty table gives no rows, columns with the names of results are
    replaced, others stay. Texts of over LONG bytes are written once, so that their rows have fixed numbers, and their
    byte ranges are read by many tasks; a long stretch without any safe place to cut is read by one.
    """
    with open(byte_level, "rb") as x, open(pieces, "rb") as y:
        shared = df.sparkSession.sparkContext.broadcast((x.read(), y.read()))
    own = ("n_a", "n_b", "groups", "links")
    rest = [c for c in df.columns if c not in own]
    body = df.select(*rest)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _models(shared)
        for batch in batches:
            at, texts = 0, batch[text].cast(pa.binary())
            for held in _portions((b" " + (t.as_py() or b""), 0, len(t.as_py() or b"") + 1) for t in texts):
                found = [finished(f) if len(u) > 1 else (0, 0, b"", b"") for f, (u, _, _) in zip(fragments(a, b, held), held)]
                done = [pa.array(x, kind) for x, kind in zip(zip(*found), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([*[batch[c].slice(at, len(held)) for c in rest], *done], [*rest, *own])
                at += len(held)

    def shown(done: DataFrame) -> DataFrame:
        return done.select(*rest, *[(F.col(c).cast("string") if c == "groups" else F.col(c)).alias(c) for c in own])

    is_long = F.coalesce(F.octet_length(text), F.lit(0)) > LONG
    schema = T.StructType([*body.schema, *T._parse_datatype_string("n_a long, n_b long, groups binary, links binary")])
    out = shown(body.filter(~is_long).mapInArrow(whole, schema))
    long = freeze(body.filter(is_long).withColumn("__row", F.monotonically_increasing_id()))
    return out.unionByName(shown(long.join(_long_texts(long, text, shared), "__row"))) if long.head(1) else out


def pair_bound(byte_level: str, pieces: str) -> int:
    """Most pairs of ids that links can have: of two tokens that end together one's bytes end the other's."""
    with open(byte_level, "rb") as x, open(pieces, "rb") as y:
        sides = ByteLevel(x.read()).surfaces, Pieces(y.read()).surfaces
    total = 0
    for one, other in (sides, sides[::-1]):
        same: dict[bytes, int] = {}
        for s in one:
            same[s] = same.get(s, 0) + 1
        total += sum(same.get(s[k:], 0) for s in other for k in range(len(s)))
    return total


def pair_counts(aligned: DataFrame, links: str = "links") -> DataFrame:
    """(a_id, b_id, n): how many links of all rows hold each pair of ids. Every task counts what it reads before anything is shuffled."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, times = np.empty(0, np.uint64), np.empty(0, np.int64)
        for batch in batches:
            for held in _portions(((x.as_py() or b"",) for x in batch["links"]), _LINKS):
                new, n = np.unique(np.frombuffer(b"".join(x for x, in held), "<u8"), return_counts=True)
                keys, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
                times = np.bincount(at, np.concatenate([times, n]), len(keys)).astype(np.int64)
        ids = ((keys & np.uint64(0xFFFFFFFF)).astype(np.int64), (keys >> np.uint64(32)).astype(np.int64))
        yield pa.RecordBatch.from_arrays([*map(pa.array, ids), pa.array(times)], ["a_id", "b_id", "n"])

    each = aligned.select(F.col(links).alias("links")).mapInArrow(counted, "a_id long, b_id long, n long")
    return each.groupBy("a_id", "b_id").agg(F.sum("n").alias("n"))


def with_scores(aligned: DataFrame, counts: DataFrame, links: str = "links") -> DataFrame:
    """`aligned` with n_groups, n_links, n_best (links whose pair is the most frequent of its b id, ties included) and count_sum (over links).

    `counts` are those of `pair_counts`; they have `pair_bound` rows at most (some 900,000 for vocabularies of 50,000 and 32,000), whatever the
    number of texts, so they pass through the driver as one broadcast. A null in `links` counts as none; pairs missing in `counts` count 0.
    """
    table = counts.select((F.col("b_id") * F.lit(2**32) + F.col("a_id")).alias("key"), "b_id", "n").toPandas().sort_values("key")
    best = table["n"] == table.groupby("b_id")["n"].transform("max")
    shared = aligned.sparkSession.sparkContext.broadcast((table["key"].to_numpy(np.uint64), table["n"].to_numpy(np.int64), best.to_numpy(bool)))

    own = ("n_groups", "n_links", "n_best", "count_sum")
    rest = [c for c in aligned.columns if c not in own]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, top = shared.value
        keys, n, top = np.append(keys, ~np.uint64(0)), np.append(n, 0), np.append(top, False)
        for batch in batches:
            done = 0
            for held in _portions((x.as_py() or b"",) for x in batch[links]):
                found = np.frombuffer(b"".join(x for x, in held), "<u8")
                at = np.searchsorted(keys, found)
                at = np.where(keys[at] == found, at, len(keys) - 1)
                ends = _offsets(np.array([len(x) // 8 for x, in held], np.int64))
                count, best, total = (np.diff(x) for x in (ends, _offsets(top[at].astype(np.int64))[ends], _offsets(n[at])[ends]))
                columns = [batch[c].slice(done, len(held)) for c in rest]
                yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, (count, count, best, total))], [*rest, *own])
                done += len(held)

    numbers = T._parse_datatype_string(", ".join(f"{c} long" for c in own))
    return aligned.select(*rest).mapInArrow(scored, T.StructType([*aligned.select(*rest).schema, *numbers]))
