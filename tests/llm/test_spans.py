"""Cross-tokenizer alignment, fill-in-middle and substring dedup against plain forms, and their defined edge cases."""

from __future__ import annotations

import hashlib
import itertools
import os
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parcelytics.llm import alignment, fill_middle, substrings
from parcelytics.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string"
FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
CLASHES = ("n", "form", "output", "n_words", "removed", "kept", "groups", "links", "place", "__row_", "seq", "hashes", "bucket")


def odd_rows():
    rng = random.Random(9)
    passage = " ".join(f"p{i % 70}" for i in range(90))
    alphabet = "ab cd  é漢字 \n\t😀's 12 3.,;- Привет \x00　"
    long = " ".join(rng.choice(["word", "слово", "x" * 30, "漢字", "it's", "3.14"]) + str(rng.randrange(900)) for _ in range(30000))
    rows = [
        (1, f"start {passage} end"), (2, f"{passage} other"), (2, f"{passage} other"), (3, None), (4, ""), (5, " \t\n"), (None, passage), (None, None),
        (6, long), (7, long[:150000] + " changed " + long[150000:]), (8, "a <P> b"), (9, "▁ is the mark of a space"), (10, "<|endoftext|> <s> it's"), (10, "short"),
        (11, "y" * 100000), (12, " " * 300 + "z"),
    ]
    rows += [(20 + k, "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))) for k in range(40)]
    return [(i, t, None) for i, t in rows]


@pytest.fixture(scope="module")
def odd_docs(spark):
    frame = spark.createDataFrame(odd_rows(), DOCS).repartition(5)
    for clash in CLASHES:
        frame = frame.withColumn(clash, F.lit("mine"))
    return frame


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


# --- 11 cross-tokenizer alignment


@pytest.fixture(scope="module")
def libraries():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    a, b = Tokenizer.from_file(FILES[0]), sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    a.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}
    bytes_a = {i: bytes(shown[c] for c in s) for s, i in a.get_vocab().items() if i != 50256}
    bytes_b = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())]
    return a, b, bytes_a, bytes_b


def brute_alignment(libraries, text):
    """(n_a, n_b, groups, links) of one text by walking over the common ends."""
    a, b, bytes_a, bytes_b = libraries
    if not text:
        return 0, 0, "", []
    full = (" " + text).encode()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    parts_a, parts_b = [bytes_a[i] for i in ids_a], [bytes_b[i] for i in ids_b]
    if b"".join(parts_a) != full or b"".join(parts_b) != full:
        return 0, 0, "", []
    ends_a, ends_b = list(itertools.accumulate(map(len, parts_a))), list(itertools.accumulate(map(len, parts_b)))
    groups, links, i, j = [], [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        k, m = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
        groups.append(",".join(map(str, ids_a[i:k])) + "|" + ",".join(map(str, ids_b[j:m])))
        links.append((ids_a[k - 1], ids_b[m - 1]))
        i, j = k, m
    return len(ids_a), len(ids_b), ";".join(groups), links


def test_alignment_edges(spark, libraries, odd_docs, no_docs):
    out = alignment.align(odd_docs, *FILES)
    assert out.columns == [*[c for c in odd_docs.columns if c not in ("groups", "links")], "n_a", "n_b", "groups", "links"]
    got = [(r["doc_id"], r["n_a"], r["n_b"], r["groups"], list(map(tuple, np.frombuffer(r["links"], "<u4").reshape(-1, 2).tolist()))) for r in out.collect()]
    want = [(i, *brute_alignment(libraries, t)) for i, t, _ in odd_rows()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert max(len(t or "") for _, t, _ in odd_rows()) > 3 * alignment.LONG  # some went through the tree
    empty = alignment.align(no_docs, *FILES)
    assert alignment.with_scores(empty, alignment.pair_counts(empty)).collect() == []


def test_alignment_query(spark, libraries):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    found = {r["doc_id"]: brute_alignment(libraries, r["text"]) for r in rows}
    count = Counter(link for *_, links in found.values() for link in links)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(n, best.get(b, 0))
    want = sorted(
        (
            i, a, b, len(links), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links),
            hashlib.sha256(groups.encode()).hexdigest() if groups else "",
        )
        for i, (a, b, groups, links) in found.items()
    )
    assert sorted(map(tuple, QUERIES["op11_token_alignment"](spark, FOLDER).collect())) == want
    assert len(count) <= alignment.pair_bound(*FILES) < 1_000_000


def test_fragments_are_a_monoid(libraries):
    """Any way to bracket the fragments of any byte ranges gives the groups of the whole text."""
    a, b = alignment.ByteLevel(open(FILES[0], "rb").read()), alignment.Pieces(open(FILES[1], "rb").read())
    rng = random.Random(1)
    texts = [t for _, t, _ in odd_rows() if t and len(t) < 300]
    opened = 0
    for text in texts:
        full = b" " + text.encode()
        bounds = sorted({0, len(full), *(rng.randrange(1, len(full) + 1) for _ in range(6))})
        parts = alignment.fragments(a, b, [(full, x, y) for x, y in itertools.pairwise(bounds)])
        opened += sum(bool(p.tail_a) or not p.cuts for p in parts)
        while len(parts) > 1:
            k = rng.randrange(len(parts) - 1)
            parts[k : k + 2] = [alignment.union(alignment.union(parts[k], alignment.Fragment()), parts[k + 1])]
        n_a, n_b, groups, links = brute_alignment(libraries, text)
        assert alignment.finished(parts[0]) == (n_a, n_b, groups.encode(), np.array(links, "<u4").tobytes())
    assert opened > 20


def test_ranges_keep_tokens(libraries, monkeypatch):
    """Ranges of a text cover it once, and tokens read range by range are those of the whole."""
    a, b = alignment.ByteLevel(open(FILES[0], "rb").read()), alignment.Pieces(open(FILES[1], "rb").read())
    text = next(t for i, t, _ in odd_rows() if i == 6)[:40000]
    for size, context in ((64, 40), (1000, 100), (1000, 3)):
        monkeypatch.setattr(alignment, "RANGE", size)
        monkeypatch.setattr(alignment, "CONTEXT", context)
        units = list(alignment.ranges(b" " + text.encode()))
        assert b"".join(u[x:y] for u, x, y in units) == b" " + text.encode()
        assert max(len(u) for u, _, _ in units) <= size + 2 * context or context == 3
        total = alignment.Fragment()
        for f in alignment.fragments(a, b, units):
            total = alignment.union(total, f)
        n_a, n_b, groups, _ = brute_alignment(libraries, text)
        assert alignment.finished(total)[:3] == (n_a, n_b, groups.encode())


def test_byte_level_libraries_agree(libraries):
    """The rank encoder and the JSON file's own library cut around every code point alike."""
    side = alignment.ByteLevel(open(FILES[0], "rb").read())
    points = [c for c in range(0, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    texts = [f"ab{chr(c)}cd 12{chr(c)}34 .{chr(c)}. {chr(c)} x{chr(c)} {chr(c)}{chr(c)}" for c in points]
    assert side.encode([t.encode() for t in texts]) == [e.ids for e in libraries[0].encode_batch(texts, add_special_tokens=False)]


# --- 12 fill-in-middle


def brute_fill(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    x, y = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:x]), "".join(units[x:y]), "".join(units[y:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_middle_edges(spark, odd_docs, no_docs):
    out = fill_middle.restore(fill_middle.transform(odd_docs))
    own = ("n", "form", "prefix_chars", "middle_chars", "output")
    assert out.columns == [*[c for c in odd_docs.columns if c not in own], *own, "restored"]
    got = sorted(((r["doc_id"], *[r[c] for c in own], r["restored"]) for r in out.collect()), key=repr)
    assert got == sorted(((i, *brute_fill(i, t), t or "") for i, t, _ in odd_rows()), key=repr)
    assert {g[2] for g in got} == {"plain", "psm", "spm"}
    assert fill_middle.restore(fill_middle.transform(no_docs)).collect() == []


def test_rotations_in_small_pieces(monkeypatch):
    monkeypatch.setattr(fill_middle, "_SWAP", 3)
    rng = random.Random(2)
    for _ in range(300):
        data = bytearray(rng.randbytes(rng.randrange(60)))
        a, mid, b = sorted(rng.randrange(len(data) + 1) for _ in range(3))
        moved = bytearray(data)
        fill_middle.rotate(moved, a, mid, b)
        assert moved == data[:a] + data[mid:b] + data[a:mid] + data[b:]
        fill_middle.rotate(moved, a, a + b - mid, b)
        assert moved == data


# --- 13 substring dedup


def brute_repeats(rows, window):
    texts = [(k, (t or "").encode().split()) for k, t in rows]
    least = {}
    for k, words in texts:
        for i in range(len(words) - window + 1 if k is not None else 0):
            seen = tuple(words[i : i + window])
            least[seen] = min(least.get(seen, k), k)
    out = []
    for k, words in texts:
        gone = [False] * len(words)
        for i in range(len(words) - window + 1 if k is not None else 0):
            if least[tuple(words[i : i + window])] < k:
                gone[i : i + window] = [True] * window
        edges = [i for i in range(len(words) + 1) if (i > 0 and gone[i - 1]) != (i < len(words) and gone[i])]
        out.append((k, len(words), sum(gone), list(zip(edges[::2], edges[1::2])), b" ".join(w for w, g in zip(words, gone) if not g).decode()))
    return sorted(out, key=repr)


def repeats_of(frame, **how):
    found = substrings.remove_repeats(frame, **how).collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], [tuple(x) for x in r["removed"]], r["kept"]) for r in found), key=repr)


def test_substring_edges(spark, odd_docs, no_docs):
    rows = [(i, t) for i, t, _ in odd_rows()]
    assert repeats_of(odd_docs) == brute_repeats(rows, 50)
    assert substrings.remove_repeats(odd_docs).columns[:2] == ["doc_id", "lang"]
    assert "place" in substrings.remove_repeats(odd_docs).columns
    assert substrings.remove_repeats(no_docs).collect() == []


@pytest.mark.parametrize("portion,bucket", [(8 << 20, 16 << 20), (300, 500), (2000, 100)])
def test_substrings_over_places(spark, monkeypatch, portion, bucket):
    """Few words, so that windows repeat everywhere; one key and missing keys hold a third of all rows each."""
    monkeypatch.setattr(substrings, "PORTION", portion)
    monkeypatch.setattr(substrings, "BUCKET", bucket)
    rng = random.Random(4)
    rows = [
        (rng.choice([3, 3, None, None, rng.randrange(200), rng.randrange(200)]), "".join(rng.choice("abc") + rng.choice(" \t\n") for _ in range(rng.randrange(40))))
        for _ in range(400)
    ]
    assert repeats_of(spark.createDataFrame(rows, "doc_id long, text string"), window=6) == brute_repeats(rows, 6)


def test_text_is_shuffled_once(spark):
    """Both readings of the places share one exchange."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    out = substrings.remove_repeats(docs)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan, plan
