"""Main text of web pages: a bidirectional LSTM in numpy labels the blocks of a page from tag paths and hashed words."""

from __future__ import annotations

import html as html_entities
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelytics.llm.sampling import smallest_keys

#: Pages (those with the smallest hash) a labeller is fitted on at most, blocks of each that it reads, passes and seed.
TRAINING_PAGES, TRAINING_BLOCKS, PASSES, SEED = 300, 50, 20, 5
#: Random frames that training reads at least, whatever the number of pages, and two of each page.
FRAMES = 1200
#: Share of these frames whose elements have names of random letters, so that place, links, lengths and neighbours must decide.
NAMELESS = 0.6
#: Share of the text outside links that the element holding the body of a page has at least.
BODY_SHARE = 0.6
#: Sizes of the path vector, the word vector and the recurrent state of a direction.
PATH, WORDS, EXTRA, STATE = 96, 24, 12, 16
INPUT = PATH + WORDS + EXTRA

# Fixed values of HTML: elements without an end tag, whose text isn't shown, and that part blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title svg iframe object textarea select option datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style textarea title noscript template iframe".split())
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title html head".split())
# A name and attributes: quotes count only after an equals sign, a bare value goes on to the next blank or `>`. Nothing is read twice,
# so a page costs in proportion to its length.
_TAG = re.compile(
    r"(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)"
    r"(?P<attr>(?>[\s/]++|[^\s/>=]++(?:\s*+=\s*+(?>\"[^\"]*+\"|'[^']*+'|(?P<bare>[^\s>\"'][^\s>]*+)))?+|=)*+)"
)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW}
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+|[0-9]+")


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int  # characters inside links


def _element(tag: str, attributes: str) -> str:
    """The element as one word per name: its tag, then the parts of its class, id and role."""
    words = []
    if "=" in attributes:
        for m in _NAMES.finditer(attributes):
            words += _PART.findall((m[2] or m[3] or m[4] or "").lower())
    return " ".join([tag, *words])


def blocks_of(page: str | None) -> list[Block]:
    """Runs of text between block elements, with the elements that stand open around them.

    Character references are decoded, white space becomes one blank, line breaks count as white space, comments and what
    a browser doesn't show are left out. End tags that are missing are implied: a new paragraph, item, cell or row ends
    the one before; an end tag closes everything opened inside its element; a stray one is ignored.
    """
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    text: list[str] = []
    linked = hidden = links = at = 0
    if not page:
        return out

    def flush() -> None:
        nonlocal linked
        joined = " ".join(html_entities.unescape("".join(text)).split())
        if joined:
            out.append(Block(tuple(e for t, e in stack if t in BLOCK or len(e) > len(t)), joined, linked))
        text.clear()
        linked = 0

    def close(to: int) -> None:
        nonlocal hidden, links
        for t, _ in stack[to:]:
            hidden -= t in HIDDEN
            links -= t == "a"
        del stack[to:]

    def say(piece: str) -> None:
        nonlocal linked
        if hidden and stack and stack[-1][0] == "head" and piece.strip():
            close(len(stack) - 1)
        if not hidden:
            text.append(piece)
            linked += len(piece) if links else 0

    while at < len(page):
        opened = page.find("<", at)
        if opened != at:
            say(page[at : opened if opened >= 0 else len(page)])
            if opened < 0:
                break
        m = _TAG.match(page, opened + 1)
        if not m:
            at = _after_other(page, opened)
            if at == opened:  # no markup
                say("<")
                at += 1
            continue
        if m.end() == len(page):  # a tag that is cut off
            break
        at, tag = m.end() + 1, m["tag"].lower()
        if m["end"]:
            found = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if found is not None:
                if tag in BLOCK:
                    flush()
                close(found)
            continue
        if tag in RAW:
            over = _RAW_END[tag].search(page, at)
            at = over.end() if over else len(page)
            continue
        if hidden:
            _end_hidden(stack, tag, close)
        if tag in BLOCK:
            flush()
            own = {"p": (), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}.get(tag, ())
            stop = {"li": ("ul", "ol", "menu"), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}.get(tag, ("dl",))
            for i in range(len(stack) - 1, -1, -1):
                name = stack[i][0]
                if name == "p" or name in own:
                    close(i)
                    if name in own:
                        break
                elif name in BLOCK and (not own or name in stop):
                    break
        elif tag == "br":
            text.append(" ")
        closed = page[m.end() - 1] == "/" and m.end("bare") != m.end()
        if tag in VOID or closed and tag not in BLOCK:
            continue
        stack.append((tag, _element(tag, m["attr"])))
        hidden += tag in HIDDEN
        links += tag == "a"
    flush()
    return out


def _after_other(page: str, at: int) -> int:
    """Where a comment, declaration or stray end that begins at `at` is over; `at` itself if nothing of the kind begins there."""
    for begin, end in (("<!--", "-->"), ("<![CDATA[", "]]>")):
        if page.startswith(begin, at):
            over = page.find(end, at + 2)
            return over + len(end) if over >= 0 else len(page)
    if page[at + 1 : at + 2] in ("!", "?", "/"):
        over = page.find(">", at)
        return over + 1 if over >= 0 else len(page)
    return at


def _end_hidden(stack: list[tuple[str, str]], tag: str, close) -> None:
    """Close what a start tag ends by itself: a head by what can't stand in one, a choice or a drawing by a block."""
    for i in range(len(stack) - 1, -1, -1):
        name = stack[i][0]
        if name == "head" and tag not in IN_HEAD or name in ("select", "datalist", "svg") and tag in BLOCK and tag not in ("option", "hr"):
            close(i)
        elif name == "foreignobject":
            return


_PATHS: dict[tuple[str, ...], np.ndarray] = {}


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    found = _PATHS.get(path)
    if found is None:
        found = np.zeros(PATH, np.float32)
        for depth, element in enumerate(reversed(path)):
            for k, word in enumerate(element.split()):
                h = zlib.crc32(f"{'tag' if k == 0 else 'name'}:{word}".encode())
                found[h % PATH] += (1 if h >> 31 else -1) * (1.0 if depth < 2 else 0.8)
        if len(_PATHS) < 50_000:
            _PATHS[path] = found
    return found


def _layout(blocks: list[Block]) -> list[tuple[float, ...]]:
    """Where each block stands to the body of its page, the deepest element path that holds most of the text outside links.

    Inside it or not, the share of its path in common, the depth below, the share of the page's text in its own part of the
    body (or of the page, outside), and how much of the body's text comes before.
    """
    weight: dict[tuple[str, ...], int] = {}
    for b in blocks:
        weight[b.path] = weight.get(b.path, 0) + max(len(b.text) - b.linked, 0)
    under: dict[tuple[str, ...], int] = {}
    for path, n in weight.items():
        for depth in range(len(path) + 1):
            under[path[:depth]] = under.get(path[:depth], 0) + n
    whole = max(under.get((), 0), 1)
    body = max((path for path, n in under.items() if n >= BODY_SHARE * whole), key=lambda path: (len(path), under[path]), default=())
    if body and body in weight and weight[body] == under[body]:
        body = body[:-1]  # the text's own leaves: what holds them counts
    out, before, held = [], 0, max(under.get(body, 0), 1)
    for b in blocks:
        common = next((k for k, (x, y) in enumerate(zip(b.path, body)) if x != y), min(len(b.path), len(body)))
        out.append((float(common == len(body)), common / max(len(body), 1), min(len(b.path) - common, 6) / 3,
                    under[b.path[: common + 1]] / whole, before / held))
        before += common == len(body) and max(len(b.text) - b.linked, 0)
    return out


def vectors(blocks: list[Block]) -> np.ndarray:
    """A row per block: hashed tag path, hashed words, and length, links, punctuation, digits, place and layout."""
    x = np.zeros((len(blocks), INPUT), np.float32)
    for i, (b, layout) in enumerate(zip(blocks, _layout(blocks))):
        x[i, :PATH] = _path_vector(b.path)
        words = b.text.lower().split()
        h = np.fromiter(map(zlib.crc32, map(str.encode, words)), np.int64, len(words))
        counts = np.bincount(h % WORDS, np.where(h >> 31, 1.0, -1.0), WORDS)
        x[i, PATH : PATH + WORDS] = counts / max(np.linalg.norm(counts), 1)
        n = len(b.text)
        x[i, PATH + WORDS :] = (
            np.log1p(n) / 6, min(b.linked / n, 1), min(sum(map(b.text.count, ".,;!?")) / len(words), 1), sum(map(str.isdigit, b.text)) / n,
            i / len(blocks), b.text[:1].isupper(), b.text[-1:] in ".!?", *layout,
        )
    return x


class Labeller:
    """Bidirectional LSTM and a logistic output that also sees the block's own vector; weights are plain arrays."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        scale = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.w = {f"x{d}": scale(INPUT, 4 * STATE) for d in "fb"} | {f"h{d}": scale(STATE, 4 * STATE) for d in "fb"} | {f"c{d}": np.zeros(4 * STATE, np.float32) for d in "fb"}
        for d in "fb":
            self.w[f"c{d}"][STATE : 2 * STATE] = 1  # remember at first
        self.w |= {"o": scale(2 * STATE, 1), "s": scale(INPUT, 1) * np.float32(0.1), "b": np.zeros(1, np.float32)}

    def _direction(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States (steps, pages, STATE) of one direction; padding leaves the state as it is."""
        steps, pages, _ = x.shape
        pre = (x.reshape(-1, INPUT) @ self.w["x" + d] + self.w["c" + d]).reshape(steps, pages, -1)
        h, c = np.zeros((pages, STATE), np.float32), np.zeros((pages, STATE), np.float32)
        out = np.zeros((steps, pages, STATE), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = pre[t] + h @ self.w["h" + d]
            gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * STATE], -30, 30)))
            i, f, o, g = gates[:, :STATE], gates[:, STATE : 2 * STATE], gates[:, 2 * STATE :], np.tanh(z[:, 3 * STATE :])
            m = mask[t][:, None]
            new = f * c + i * g
            tanh = np.tanh(new)
            if keep is not None:
                keep.append((t, i, f, o, g, c, tanh, h))
            c = np.where(m, new, c)
            h = np.where(m, o * tanh, h)
            out[t] = h
        return out

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Log odds of main text for (steps, pages, INPUT)."""
        h = np.concatenate([self._direction(x, mask, "f"), self._direction(x, mask, "b")], axis=2)
        return (h @ self.w["o"] + x @ self.w["s"] + self.w["b"])[..., 0]

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        kept: dict[str, list] = {"f": [], "b": []}
        h = {d: self._direction(x, mask, d, kept[d]) for d in "fb"}
        both = np.concatenate([h["f"], h["b"]], axis=2)
        z = (both @ self.w["o"] + x @ self.w["s"] + self.w["b"])[..., 0]
        dz = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * mask / mask.sum())[..., None].astype(np.float32)
        grad = {"o": both.reshape(-1, 2 * STATE).T @ dz.reshape(-1, 1), "s": x.reshape(-1, INPUT).T @ dz.reshape(-1, 1), "b": dz.sum((0, 1))}
        dh_all = dz * self.w["o"][:, 0]
        for n, d in enumerate("fb"):
            own = dh_all[..., n * STATE : (n + 1) * STATE]
            dpre = np.zeros((*x.shape[:2], 4 * STATE), np.float32)
            dh, dc = np.zeros_like(own[0]), np.zeros_like(own[0])
            gh = np.zeros_like(self.w["h" + d])
            for t, i, f, o, g, c, tanh, before in reversed(kept[d]):
                m = mask[t][:, None]
                dh = dh + own[t]
                live = dh * m
                dcell = dc * m + live * o * (1 - tanh**2)
                da = np.concatenate([dcell * g * i * (1 - i), dcell * c * f * (1 - f), live * tanh * o * (1 - o), dcell * i * (1 - g**2)], axis=1)
                dpre[t] = da
                gh += before.T @ da
                dh = np.where(m, da @ self.w["h" + d].T, dh)
                dc = np.where(m, dcell * f, dc)
            flat = dpre.reshape(-1, 4 * STATE)
            grad |= {"x" + d: x.reshape(-1, INPUT).T @ flat, "h" + d: gh, "c" + d: flat.sum(0)}
        return grad

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], passes: int = PASSES, rate: float = 0.01, seed: int = SEED) -> Labeller:
        """Adam over batches of pages of similar length."""
        rng = np.random.default_rng(seed)
        pages = sorted((p for p in pages if len(p[1])), key=lambda p: len(p[1]))
        groups = [pages[at : at + 32] for at in range(0, len(pages), 32)]
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        for turn in range(passes):
            for k in rng.permutation(len(groups)):
                x, mask = padded([p[0] for p in groups[k]])
                y = padded([p[1][:, None] for p in groups[k]])[0][..., 0]
                step += 1
                for name, g in self.gradient(x, mask, y).items():
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.999 * second[name] + 0.001 * g * g
                    move = first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-7)
                    self.w[name] = (self.w[name] * (1 - 1e-4) - rate * (1 - turn / passes) * move).astype(np.float32)
        return self


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(steps, pages, width) and the mask of real steps."""
    steps = max(map(len, rows))
    x, mask = np.zeros((steps, len(rows), rows[0].shape[1]), np.float32), np.zeros((steps, len(rows)), bool)
    for k, r in enumerate(rows):
        x[: len(r), k], mask[: len(r), k] = r, True
    return x, mask


# Names by which pages tell what stands in an element: the teacher's rule, and the frames of the training pages.
MAIN = ("article", "main", "div class=content", "div class=post-content", "div class=entry", "div id=main-content", "section class=story", "div class=article-body", "div role=main", "div class=text")
BESIDE = {
    "nav": ("nav", "ul class=menu", "div class=navbar", "div id=navigation", "div class=breadcrumbs", "ol class=pagination", "div role=navigation", "div class=toc"),
    "header": ("header", "div id=header", "div class=masthead", "div class=site-title", "div class=topbar", "div role=banner"),
    "footer": ("footer", "div id=footer", "div class=site-footer", "div class=copyright", "div class=colophon", "div role=contentinfo"),
    "aside": ("aside", "div class=sidebar", "div id=sidebar", "div class=widget", "div class=related", "section class=recommended", "div role=complementary", "div class=share-buttons", "div class=author-bio"),
    "notice": ("div class=cookie-notice", "div id=cookie-banner", "div class=consent", "div role=alert", "p class=notice", "div class=alert", "div class=paywall", "div class=popup", "dialog", "div class=disclaimer"),
    "ad": ("div class=ad", "div class=ads", "div class=advert", "aside class=advertisement", "div class=sponsored", "div id=promo", "div class=banner-ad", "p class=promotion"),
    "form": ("form", "form class=search", "div class=newsletter", "form id=subscribe", "div class=login-form", "fieldset"),
    "comments": ("div id=comments", "section class=comments", "ol class=comment-list", "div class=comment", "div class=replies", "section id=respond", "div class=discussion", "div class=reader-comments"),
}
_BESIDE_WORDS = frozenset(
    w for names in BESIDE.values() for n in names for part in n.split() for w in _PART.findall(part.lower())
) - frozenset("div p ul ol section class id role list buttons site title author main content text top".split())


def teacher(block: Block) -> bool:
    """Main text by the names around a block: inside an article or main element, and in nothing that stands beside it."""
    inside = False
    for element in block.path:
        tag, *names = element.split()
        if tag in ("article", "main") or "article" in names:
            inside = True
        if tag in ("nav", "footer", "aside", "form", "dialog", "fieldset") or _BESIDE_WORDS & set(names) or tag == "header" and not inside:
            return False
    return inside


def reframed(blocks: list[Block], rng: np.random.Generator) -> tuple[list[Block], list[bool]]:
    """A page's blocks in another frame: main text under another name, and other things before, inside and after it.

    Texts are the page's own, so only paths, lengths, links and neighbours tell the parts apart. In a share of the frames
    names are random letters and most elements plain ones: there what stands beside comes in its usual place.
    """
    main = [b for b in blocks if teacher(b)] or blocks
    words = [w for b in blocks for w in b.text.split()] or ["x"]
    nameless = rng.random() < NAMELESS
    renamed: dict[str, str] = {}

    def element(frame: str) -> str:
        tag, *rest = frame.split()
        if not nameless:
            return _element(tag, " ".join(rest))
        if frame not in renamed:
            letters = "".join("abcdefghijklmnopqrstuvwxyz"[k] for k in rng.integers(0, 26, int(rng.integers(2, 11))))
            plain = ("div", "div", "div", "section", tag)[rng.integers(5)]
            renamed[frame] = _element(plain, f"{('class', 'id')[rng.integers(2)]}={letters}" if rng.random() < 0.85 else "")
        return renamed[frame]

    def some(low: int, high: int) -> str:
        n = int(rng.integers(low, high + 1))
        at = int(rng.integers(0, max(1, len(words) - n)))
        return " ".join(words[at : at + n]) or "x"

    def beside(base: tuple[str, ...], kinds: tuple[str, ...] = tuple(BESIDE)) -> list[Block]:
        kind = kinds[rng.integers(len(kinds))]
        frames = BESIDE[kind]
        path = (*base, element(frames[rng.integers(len(frames))]))
        out = []
        for _ in range(int(rng.integers(1, 7 if kind in ("nav", "comments", "aside") else 3))):
            long = kind in ("comments", "notice", "ad", "aside") and rng.random() < 0.6
            text = some(4, 40) if long else some(1, 8)
            inner = {"nav": ("ul", "li"), "comments": (element("div class=comment"),) if rng.random() < 0.5 else ("li",), "form": ("label",)}.get(kind, ())
            inner = () if rng.random() < 0.3 else tuple(inner)
            leaf = ("p",) if long and rng.random() < 0.6 else ()
            links = len(text) if kind == "nav" or kind in ("aside", "footer") and rng.random() < 0.5 else 0
            out.append(Block((*path, *inner, *leaf), text, links))
        return out

    outer = ("html", "body") if rng.random() < 0.6 else ("html", "body", element(("div class=wrapper", "div id=page", "div class=container", "div")[rng.integers(4)]))
    frame = (*outer, element(MAIN[0] if rng.random() < 0.4 else MAIN[rng.integers(len(MAIN))]))
    if rng.random() < 0.2:
        frame = (*outer, "main", element(MAIN[rng.integers(len(MAIN))]))
    out: list[Block] = []
    marks: list[bool] = []

    def add(more: list[Block], mark: bool) -> None:
        out.extend(more)
        marks.extend([mark] * len(more))

    first = ("nav", "header", "notice", "ad", "form") if nameless else tuple(BESIDE)
    for _ in range(int(rng.integers(0, 4))):
        add(beside(outer, first), False)
    cut = int(rng.integers(1, len(main) + 1))
    title = (*frame, "header") if rng.random() < 0.2 else frame
    for k, b in enumerate(main[:TRAINING_BLOCKS]):
        leaf = b.path[-1].split()[0] if b.path else "p"
        leaf = leaf if leaf in ("p", "h1", "h2", "h3", "li", "blockquote", "td", "pre", "dd", "figcaption") else "p"
        if k and rng.random() < 0.3:
            leaf = ("h2", "h3", "li", "li", "li", "blockquote", "td", "pre", "div")[rng.integers(9)]
        holder = (*title, "h1") if k == 0 and leaf == "h1" else (*frame, "ul", leaf) if leaf == "li" else (*frame, leaf)
        add([Block(holder, b.text if rng.random() < (0.4 if leaf in ("li", "td", "h2", "h3") else 0.8) else some(1, 30), 0 if rng.random() < 0.9 else b.linked)], True)
        if k + 1 == cut and rng.random() < 0.5:
            add(beside(frame), False)
    last = ("comments", "comments", "aside", "ad", "form", "nav") if nameless else tuple(BESIDE)
    for _ in range(int(rng.integers(0, 4))):
        add(beside(frame if rng.random() < 0.25 else outer, last), False)
    if nameless and rng.random() < 0.7:
        add(beside(outer, ("footer",)), False)
    return out, marks


def fit(pages: DataFrame, html: str = "html", most: int = TRAINING_PAGES, seed: int = SEED) -> Labeller:
    """A labeller from at most `most` different pages, those whose hash is smallest; copies count and are read once.

    Each page is read as it stands, labelled by the names around its blocks, and again in random frames whose labels are
    known: two for each page, more where pages are few. Pages without such names still train through their frames. An empty table gives the labeller of the
    frames of a made-up page.
    """
    chosen = smallest_keys(pages.filter(F.col(html).isNotNull()).select(F.col(html).alias("html")), F.col("html"), most).distinct().orderBy("html").collect()
    rng = np.random.default_rng(seed)
    data = []
    for page in [r["html"] for r in chosen] or ["<article><h1>One title</h1><p>Some text, and more of it.</p></article>"]:
        blocks = blocks_of(page)
        if not blocks:
            continue
        if any(map(teacher, blocks)):
            data.append((vectors(blocks)[:TRAINING_BLOCKS], np.array([teacher(b) for b in blocks], np.float32)[:TRAINING_BLOCKS]))
        for _ in range(max(2, -(-FRAMES // max(len(chosen), 1)))):
            own, marks = reframed(blocks[:TRAINING_BLOCKS], rng)
            data.append((vectors(own)[: 2 * TRAINING_BLOCKS], np.array(marks, np.float32)[: 2 * TRAINING_BLOCKS]))
    return Labeller(seed).fit(data)


def label(pages: list[list[Block]], model: Labeller, most: int = 4000) -> list[np.ndarray]:
    """For each page, which of its blocks are main text; pages of similar length are read together."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
    while order:
        take = max(1, next((n for n in range(1, len(order) + 1) if n * len(pages[order[n - 1]]) > most), len(order) + 1) - 1)
        part, order = order[:take], order[take:]
        x, mask = padded([vectors(pages[k]) for k in part])
        z = model.scores(x, mask)
        for j, k in enumerate(part):
            out[k] = z[: len(pages[k]), j] > 0
    return out


def main_text(pages: DataFrame, model: Labeller, html: str = "html", out: str = "text") -> DataFrame:
    """`pages` with the main text of each: the blocks labelled so, in page order, parted by an empty line.

    Null, empty and unreadable pages give the empty text; equal pages give equal texts; pages cut off in a tag give what
    stands before. A page of any length is read whole, all its blocks in one sequence. Other columns stay, one called
    like `out` is replaced, an empty table gives no rows.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            for at in range(0, len(batch), 250):
                blocks = [blocks_of(h) for h in batch.iloc[at : at + 250]]
                marks = label(blocks, shared.value)
                yield pd.Series(["\n\n".join(b.text for b, m in zip(bs, ms) if m) for bs, ms in zip(blocks, marks)], dtype=object)

    return pages.withColumn(out, extracted(F.col(html)))
