"""Blocks of pages: odd markup, pages of any length, and the text that the standard library's parser sees."""

from __future__ import annotations

import html
import time
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest

from parcelytics.llm.html_blocks import HIDDEN, VOID, blocks_of, fit, label, teacher

FOLDER = "/root/testdata/sf0.001"

ODD = {
    "<html><head><title>x</title><meta charset=utf-8><body><article><p>One</p></article>": ["One"],  # the end of a head is implied
    "<head><title>t</title>Text here<p>more": ["Text here", "more"],
    "<p data-t=it's>Main text one.</p><p>It's two.</p><p>Three.</p>": ["Main text one.", "It's two.", "Three."],  # a quote inside a bare value
    '<p title="abc>Main text one.</p>': ["Main text one."],  # a quote that is never closed
    '<p title="a > b">One</p>': ["One"],
    "<p>x</p><p>I am <3 happy": ["x", "I am <3 happy"],
    "<p>5 < 6 and the text ends": ["5 < 6 and the text ends"],
    "<p>a<![CDATA[x > y]]>b</p>": ["ab"],
    "<!-->x<p>y<!-- > -->z": ["x", "yz"],
    "<svg><path d='x'><title>q</title></svg><p>after</p>": ["after"],
    "<svg><g><p>broke out</p>": ["broke out"],
    "<select><option>a<option>b<div>text</div>": ["text"],
    "x </ bogus> y": ["x y"],
    "<p>cut <a href='x": ["cut"],
    "<script>a<b</script><p>k<script>never closed <p>gone": ["k"],
    "": [], "   ": [],
}


@pytest.mark.parametrize("page", ODD)
def test_odd_markup(page):
    assert [b.text for b in blocks_of(page)] == ODD[page]


def test_links_with_bare_addresses():
    assert [(b.text, b.linked) for b in blocks_of("<p><a href=/foo/>link</a> rest <br/> end</p>")] == [("link rest end", 4)]


@pytest.mark.parametrize("piece", ["<script ", "<a ", "<a x='", '<a b="', "<!--", "</", "<script>", "<p <", "<![CDATA[", "<", "<p>", "a&amp;b<br>"])
def test_long_pages_cost_in_proportion(piece):
    begin = time.process_time()
    blocks_of(piece * (400_000 // len(piece)))
    assert time.process_time() - begin < 5


class Shown(HTMLParser):
    """Everything outside hidden elements, without white space."""

    def __init__(self):
        super().__init__()
        self.open, self.text = [], []

    def handle_starttag(self, tag, attrs):
        if tag not in VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data):
        if not HIDDEN & set(self.open):
            self.text.append(data)


def test_blocks_hold_the_text_that_another_parser_sees(spark):
    pages = [r["html"] for r in spark.read.parquet(f"{FOLDER}/pages.parquet").select("html").collect() if r["html"]]
    for page in pages:
        parser = Shown()
        parser.feed(page)
        parser.close()
        assert "".join("".join(b.text.split()) for b in blocks_of(page)) == "".join("".join(parser.text).split())


# Names that neither the teacher's rule nor the named training frames hold.
STRANGE = {
    "main": ("story-body", "c1", "pagina", "texto", "inhalt", "bd"),
    "nav": ("gnb", "leiste", "m2", "tabs-oben"), "footer": ("impressum", "fuss", "z9", "pie"),
    "comments": ("disqus-thread", "kommentare", "meinungen", "fb-root"),
}


def strange_page(rng, blocks):
    """A page under unknown names: menu, main text, reader comments, footer; with the kind of each block."""
    name = {k: v[rng.integers(len(v))] for k, v in STRANGE.items()}
    words = [w for b in blocks for w in b.text.split()]

    def some(low, high):
        n = int(rng.integers(low, high))
        at = int(rng.integers(0, max(1, len(words) - n)))
        return " ".join(words[at : at + n])

    parts = [("nav", f"<a href=/{k}>{w}</a>", "li") for k, w in enumerate(words[: int(rng.integers(3, 8))])]
    parts += [("main", b.text, b.path[-1].split()[0] if b.path[-1].split()[0] in ("h1", "h2") else "p") for b in blocks]
    for _ in range(int(rng.integers(1, 5))):
        parts += [("comments", some(6, 30), "p")]
    parts += [("footer", "© 2021 " + some(2, 8), "p"), ("footer", "<a href=/x>" + some(1, 4) + "</a>", "p")]
    page, kinds, open_kind = ["<body>"], [], None
    for kind, text, leaf in parts:
        if kind != open_kind:
            page.append(("</div>" if open_kind else "") + f"<div class={name[kind]}>")
            open_kind = kind
        shown = text if text.startswith("<a ") else "© " + html.escape(text[2:]) if kind == "footer" else html.escape(text)
        page.append(f"<{leaf}>{shown}</{leaf}>")
        kinds.append(kind)
    return "".join(page) + "</div></body>", kinds


def test_unknown_names(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    model = fit(pages)
    rng = np.random.default_rng(8)
    seen, right = Counter(), Counter()
    for r in spark.read.parquet(f"{FOLDER}/pages.parquet").select("html").orderBy("page_id").collect():
        own = [b for b in blocks_of(r["html"] or "") if teacher(b)]
        if not own:
            continue
        page, kinds = strange_page(rng, own)
        blocks = blocks_of(page)
        assert len(blocks) == len(kinds)
        sizes = Counter()
        for kind, block in zip(kinds, blocks):
            sizes[kind] += len(block.text)
        for kind, kept in zip(kinds, label([blocks], model)[0]):
            for group in (kind, "comments, fewer than text") if kind == "comments" and sizes["comments"] < sizes["main"] else (kind,):
                seen[group] += 1
                right[group] += bool(kept) == (kind == "main")
    shares = {k: right[k] / seen[k] for k in seen}
    assert shares["main"] >= 0.98 and min(shares[k] for k in ("nav", "footer", "comments, fewer than text")) >= 0.95, (shares, seen)
    assert shares["comments"] >= 0.85, (shares, seen)
