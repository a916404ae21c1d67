"""Licence scan: normalised passages compared with licence templates by the Dice coefficient over word bigrams."""

from __future__ import annotations

import bisect
import heapq
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelytics.llm.license_texts import BODIES

#: Dice coefficient from which a passage is taken as a licence.
THRESHOLD = 0.8

# Names of licences as notices write them, the notices, and texts of short licences.
NAMES = {
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0"),
    "MIT": ("the MIT License",),
    "GPL-3.0": ("the GNU General Public License, version 3", "the GNU General Public License v3.0"),
    "GPL-2.0": ("the GNU General Public License, version 2", "the GNU General Public License v2.0"),
    "LGPL-3.0": ("the GNU Lesser General Public License, version 3",),
    "AGPL-3.0": ("the GNU Affero General Public License, version 3",),
    "MPL-2.0": ("the Mozilla Public License, version 2.0",),
    "BSD-3-Clause": ("the BSD 3-Clause License",),
    "BSD-2-Clause": ("the BSD 2-Clause License",),
    "CC0-1.0": ("CC0 1.0",),
    "CC-BY-4.0": ("CC BY 4.0", "the Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0",),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0",),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0",),
}
NOTICES = ("Licensed under {}.", "Released under {}.", "This work is licensed under {}.", "Distributed under the terms of {}.")
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS
ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE
LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to
in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
express or implied. See the License for the specific language governing permissions and limitations under the License.""",
}

_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
#: Templates of more bigrams have no anchor words; texts long enough for one are compared by their bigrams.
_LONG = 500
_SPLIT = re.compile(r"\n[ \t\r\f\v]*\n")


def templates() -> dict[str, list[str]]:
    """Licence to its templates: every notice with every name, the texts, and the standard headers."""
    out = {k: [n.format(name) for name in names for n in NOTICES] for k, names in NAMES.items()}
    for k, text in TEXTS.items():
        out.setdefault(k, []).append(text)
    for k, texts in BODIES.items():
        out.setdefault(k, []).extend(texts)
    return out


def normalised(text: str) -> list[str]:
    """Lower-case words; numbers with their points, so 2.0 is one word; all other signs part words."""
    return _WORD.findall(text.lower())


def bigrams(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:]))


@dataclass
class Templates:
    """Bigram sets by size, and words of which a passage that reaches the threshold must hold one."""

    threshold: float
    rows: list[tuple[str, set]] = field(default_factory=list)
    anchors: set[str] = field(default_factory=set)

    def __post_init__(self):
        seen = set()
        for name, texts in sorted(templates().items()):
            for text in texts:
                found = frozenset(bigrams(normalised(text)))
                if (name, found) not in seen:
                    seen.add((name, found))
                    self.rows.append((name, set(found)))
        self.rows.sort(key=lambda r: (len(r[1]), r[0]))
        self.sizes = np.array([len(s) for _, s in self.rows])
        # A Dice coefficient of t needs t / (2 - t) of the template's bigrams at least: if more than the rest of them hold
        # an anchor word, every passage that reaches t holds one. Words of few templates come first.
        use: dict[str, int] = {}
        for _, s in self.rows:
            for w in {w for pair in s for w in pair}:
                use[w] = use.get(w, 0) + 1
        plain = set("the of or a to under is this in and any for work terms".split())
        for _, s in self.rows:
            if len(s) > _LONG:
                continue
            spare = len(s) - self.threshold / (2 - self.threshold) * len(s)
            words = sorted({w for pair in s for w in pair}, key=lambda w: (w in plain, w not in ("license", "licensed", "released"), -len(w), w))
            for w in words:
                if sum(a in self.anchors or b in self.anchors for a, b in s) > spare + 1e-9:
                    break
                self.anchors.add(w)
        self.pattern = re.compile("|".join(sorted(map(re.escape, self.anchors), key=lambda w: (-len(w), w))))
        names = {k: [bigrams(normalised(n)) for n in own] for k, own in NAMES.items()}
        #: Bigrams of the name in a notice (none in a text), so that a window can't be a notice by its common words alone.
        self.cores = [max((c for c in names.get(name, ()) if c <= s and len(s) < 2 * len(c) + 10), key=len, default=set()) for name, s in self.rows]
        self.holding: dict[tuple[str, str], list[int]] = {}
        for k, (_, s) in enumerate(self.rows):
            for pair in s:
                self.holding.setdefault(pair, []).append(k)
        least = self.threshold / (2 - self.threshold)
        #: Words of a text that reaches a template without anchor words, at least.
        self.long = min((least * n for n in self.sizes if n > _LONG), default=float("inf"))
        self.of: dict[str, list[int]] = {}
        for k, (name, _) in enumerate(self.rows):
            self.of.setdefault(name, []).append(k)

    def shared(self, own: set[tuple[str, str]], name: str) -> int:
        """Bigrams of `own` that the nearest template of a licence holds."""
        return max(len(own & self.rows[k][1]) for k in self.of[name])

    def best(self, words: list[str]) -> list[tuple[str, float]]:
        """Licences whose best template reaches the threshold, best first; size bounds leave out the other templates."""
        own = bigrams(words)
        t, n, out = self.threshold, len(own), {}
        lo, hi = np.searchsorted(self.sizes, n * t / (2 - t) - 1e-9), np.searchsorted(self.sizes, n * (2 - t) / t + 1e-9, side="right")
        for name, s in self.rows[lo:hi]:
            dice = 2 * len(own & s) / (n + len(s))
            if dice >= t - 1e-12:
                out[name] = max(dice, out.get(name, 0.0))
        return sorted(out.items(), key=lambda r: (-r[1], r[0]))


def passages(text: str) -> Iterator[tuple[int, int]]:
    """Lines, paragraphs (parted by empty lines) of several lines, and the whole text, as (start, end), without repeats."""
    seen = set()
    for m in re.finditer(r"[^\n]+", text):
        seen.add((m.start(), m.end()))
    at = 0
    for m in [*_SPLIT.finditer(text), None]:
        end = m.start() if m else len(text)
        if end > at:
            seen.add((at, end))
        at = m.end() if m else at
    if text:
        seen.add((0, len(text)))
    return iter(sorted(seen))


def _places(text: str, plain: str) -> tuple[list[int], list[int]]:
    """Starts and ends of the words of `plain`, the text in lower case, as places in the text."""
    found = [m.span() for m in _WORD.finditer(plain)]
    if len(plain) != len(text):  # signs that grow in lower case
        at = np.repeat(np.arange(len(text)), [len(c.lower()) for c in text])
        return [int(at[s]) for s, _ in found], [int(at[e - 1]) + 1 for _, e in found]
    return [s for s, _ in found], [e for _, e in found]


def _best_windows(
    inside: np.ndarray, core: np.ndarray, before: np.ndarray, after: np.ndarray, size: int, least: float, threshold: float
) -> list[tuple[float, int, int]]:
    """(dice, first, last) of the windows of bigrams nearest to a template, best first, without a common word.

    `inside` tells which bigrams of the text are in the template of `size` bigrams, `core` which are in its licence's name, of
    which a window holds `least`; `before` and `after` are the places where the same bigram stands next. Of all windows the best is taken, of equal ones the shortest, then the first, and so on beside
    those taken. A shortest best window starts with a bigram of the template that it doesn't hold again, and size bounds end it.
    """
    most = int(size * (2 - threshold) / threshold + 1e-9)

    def best(i: int, last: int) -> tuple[float, int, int, int] | None:
        last, span = min(last, int(after[i]) - 1), 2 * most
        while True:
            to = min(i + span, last + 1)
            new = before[i:to] < i
            n = np.cumsum(new)
            if to > last or n[-1] > most:
                break
            span *= 4
        n = n[: np.searchsorted(n, most, side="right")]
        new, here = new[: len(n)], slice(i, i + len(n))
        dice = 2 * np.cumsum(new & inside[here]) / (n + size) * (np.cumsum(new & core[here]) >= least)
        k = int(np.argmax(dice))
        return (-float(dice[k]), k, i, i + k) if dice[k] >= threshold - 1e-12 else None

    starts = np.flatnonzero(inside)
    starts = starts[: max(0, len(starts) - int(np.ceil(size * threshold / (2 - threshold) - 1e-9)) + 1)]  # enough of it must follow
    queue = [w for i in starts.tolist() if (w := best(i, len(inside) - 1))]
    heapq.heapify(queue)
    starts, taken = [], {}
    while queue:
        dice, _, first, last = heapq.heappop(queue)
        k = bisect.bisect_right(starts, first)
        if k and taken[starts[k - 1]][2] + 1 >= first:
            continue
        if k < len(starts) and last + 1 >= starts[k]:  # it meets a better one: what is best before that
            if starts[k] - 2 >= first and (w := best(first, starts[k] - 2)):
                heapq.heappush(queue, w)
            continue
        starts.insert(k, first)
        taken[first] = (-dice, first, last)
    return list(taken.values())


def _near(pairs: list[tuple[str, str]], known: Templates) -> list[int]:
    """Templates that a part of the text can reach: at t it holds t / (2 - t) of the template's bigrams at least."""
    counts: dict[int, int] = {}
    for pair in known.holding.keys() & set(pairs):
        for k in known.holding[pair]:
            counts[k] = counts.get(k, 0) + 1
    least = known.threshold / (2 - known.threshold)
    return sorted(k for k, n in counts.items() if n >= least * known.sizes[k] - 1e-9)


def _windows(
    text: str, plain: str, words: list[str], near: list[int], known: Templates, taken: list[tuple[str, float, int, int]]
) -> list[tuple[str, float, int, int]]:
    """(licence, dice, start, end) of the word windows that are a licence and that no span of `taken` tells already."""
    pairs = list(zip(words, words[1:]))
    least = known.threshold / (2 - known.threshold)
    seen: dict[tuple[str, str], int] = {}
    before, after = np.full(len(pairs), -1), np.full(len(pairs), len(pairs))
    for at, pair in enumerate(pairs):
        old = seen.get(pair, -1)
        before[at] = old
        if old >= 0:
            after[old] = at
        seen[pair] = at
    found = []
    for k in near:
        name, s = known.rows[k]
        inside = np.fromiter((pair in s for pair in pairs), bool, len(pairs))
        core = np.fromiter((pair in known.cores[k] for pair in pairs), bool, len(pairs))
        best = _best_windows(inside, core, before, after, len(s), least * len(known.cores[k]) - 1e-9, known.threshold)
        found += [(-dice, first - last, first, name, last) for dice, first, last in best]
    starts, ends = _places(text, plain)
    over: list[set[str]] = [set() for _ in words]  # licences of the spans that a word stands in
    for name, _, start, end in taken:
        for w in over[bisect.bisect_right(ends, start) : bisect.bisect_left(starts, end)]:
            w.add(name)
    out: list[tuple[str, float, int, int]] = []
    for dice, _, first, name, last in sorted(found):
        own, covered = set(pairs[first : last + 1]), Counter(chain.from_iterable(over[first : last + 2]))
        told = {n for n, c in covered.items() if 2 * c >= last + 2 - first}
        if name not in told and not any(known.shared(own, n) >= known.shared(own, name) for n in told):
            out.append((name, -dice, starts[first], ends[last + 1]))
            for w in over[first : last + 2]:
                w.add(name)
    return out


def find(text: str, known: Templates) -> list[tuple[str, float, int, int]]:
    """(licence, dice, start, end) of every passage that is a licence, with its best licence, ties going to the first name, and
    of the best word windows for what stands across or inside passages."""
    plain = text.lower()
    hits = np.array([m.start() for m in known.pattern.finditer(plain)], np.int64)
    # every word but the last takes a sign and a space at least
    if not len(hits) and len(plain) < 2 * known.long:
        return []
    every = _WORD.findall(plain)
    near = _near(list(zip(every, every[1:])), known)
    if not near:
        return []
    large = known.sizes[near[-1]] > _LONG
    aligned = len(plain) == len(text)  # rare signs grow in lower case; then places don't tell which passage they are in
    most = int(known.sizes[-1] * (2 - known.threshold) / known.threshold) + 1
    out = []
    for start, end in passages(text):
        if aligned and not large and np.searchsorted(hits, start) == np.searchsorted(hits, end):
            continue  # no anchor word in it
        words = normalised(text[start:end])
        # a passage of more different bigrams than the largest template allows can't reach the threshold
        if len(words) < 2 or len(words) > most and len(bigrams(words)) > most:
            continue
        best = known.best(words)
        if best:
            out.append((best[0][0], best[0][1], start, end))
    windows = _windows(text, plain, every, near, known, out)

    def part(name: str, dice: float, start: int, end: int) -> bool:
        """Whether a passage is a part of another licence's window, which holds its words as well."""
        over = {n for n, d, s, e in windows if n != name and s <= start and end <= e and d >= dice}
        own = bigrams(normalised(text[start:end])) if over else set()
        return any(known.shared(own, n) >= known.shared(own, name) for n in over)

    return sorted([r for r in out if not part(*r)] + windows, key=lambda r: (r[2], r[3]))


def scan(df: DataFrame, text: str = "text", out: str = "licenses", threshold: float = THRESHOLD) -> DataFrame:
    """`df` with the licence passages of each whole text: an array of (license, dice, start, end), by start, then end.

    Places count code points, end exclusive. A passage is a line, a paragraph or the whole text; nested ones that reach
    the threshold are all listed. A licence that stands inside a line or over several paragraphs is listed by its best window
    of words: best first, unless half of it stands in spans listed already of the same licence or of one that holds as many of its
    word pairs; nor is a passage listed that is a part of such a window of another licence. Null and empty texts have none, equal texts agree, an empty table gives no rows, a
    column called like `out` is replaced and all others stay. The templates are a fixed list, so nothing is shuffled.
    """

    @F.pandas_udf("array<struct<license:string,dice:double,start:int,end:int>>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Templates(threshold)
        for batch in batches:
            yield pd.Series([[dict(zip(("license", "dice", "start", "end"), r)) for r in find(t or "", known)] for t in batch], dtype=object)

    return df.withColumn(out, found(F.col(text)))
