"""The match cascade over dictionaries with many entries, collisions and near names, against a plain walk over one text at a time."""

from __future__ import annotations

import difflib
import random
import re

from parcelytics import fixed_values as fv
from parcelytics.catalog.queries_matching import text_key
from parcelytics.operators import matching

OUT = matching.OUT_OF_DISTRICT


def longest_entry(keys, words, entries, usable=all):
    """Leftmost of the longest n-grams (not of filler words only) that are entries."""
    for n in range(min(fv.MAX_NGRAM, len(keys)), 0, -1):
        for i in range(len(keys) - n + 1):
            if not all(w.lower() in fv.FILLER_WORDS for w in words[i : i + n]) and " ".join(keys[i : i + n]) in entries:
                return entries[" ".join(keys[i : i + n])], " ".join(words[i : i + n])
    return None


def whole_or_longest(text, keys, words, entries):
    if keys and " ".join(keys) in entries:
        return entries[" ".join(keys)], text
    return longest_entry(keys, words, entries)


def plain(text, names, aliases, towns, script_aliases, scripts, outside, cutoff=fv.FUZZY_CUTOFF):
    words = re.findall(r"[A-Za-z]+", text)
    keys = [text_key(w) for w in words]
    pool = sorted({k for k, _, _ in names})
    for at, (word, key) in enumerate(zip(words, keys)):
        if word.lower() in fv.FILLER_WORDS or any(w.lower() in fv.ROAD_WORDS for w in words[at + 1 : at + 3]):
            continue
        if key in towns:
            return OUT, "out_of_district", f"{towns[key]} [{word}/exact]"
        close = difflib.get_close_matches(key, sorted(towns), n=1, cutoff=cutoff) if len(key) >= 6 and key not in pool else []
        if close:
            return OUT, "out_of_district", f"{towns[close[0]]} [{word}/fuzzy~{close[0]}]"
    found = whole_or_longest(text, keys, words, aliases)
    if found:
        return found[0], "alias", found[1]
    for stage, table in (("alias", [(n, d, 0.0) for n, d in script_aliases]), ("script", scripts)):
        held = sorted((-len(n), area, n, d) for n, d, area in table if len(n) >= 3 and n in text)
        if held:
            return held[0][3], stage, held[0][2]
    for n in range(min(fv.MAX_NGRAM, len(keys)), 0, -1):
        hits = [(area, i, division, " ".join(words[i : i + n])) for i in range(len(keys) - n + 1) for k, division, area in names
                if k == " ".join(keys[i : i + n]) and not all(w.lower() in fv.FILLER_WORDS for w in words[i : i + n])]
        if hits:
            return min(hits)[2], "exact", min(hits)[3]
    codes = [int(c) for c in re.findall(fv.POSTAL_PATTERN, text) if int(c) in fv.POSTAL_AREAS]
    if codes:
        return fv.POSTAL_AREAS[codes[0]], "postal", text
    for n in range(min(fv.MAX_NGRAM, len(keys)), 0, -1):
        hits = []
        for i in range(len(keys) - n + 1):
            gram, span = " ".join(keys[i : i + n]), words[i : i + n]
            if len(gram) < 5 or any(w.lower() in fv.FILLER_WORDS for w in span):
                continue
            for close in difflib.get_close_matches(gram, pool, n=1, cutoff=cutoff):
                ratio = difflib.SequenceMatcher(None, gram, close).ratio()
                hits += [(ratio, -area, division, " ".join(span)) for k, division, area in names if k == close]
        if hits:
            best = max(hits)
            return best[2], "fuzzy", f"{best[3]} ~ {best[2]}"
    found = whole_or_longest(text, keys, words, outside)
    return (OUT, "out_of_district", found[0]) if found else None


def test_cascade_with_many_entries(spark):
    rng = random.Random(21)
    syllables = ["ga", "mo", "ra", "tu", "ve", "pi", "li", "yan", "da", "la", "ko", "he", "na", "wat", "ta", "ke", "si"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(2, 5)))
    vocabulary = sorted({word() for _ in range(60)})
    phrase = lambda most: " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, most + 1)))
    unique = lambda n, most: sorted({text_key_of(phrase(most)) for _ in range(n)})
    text_key_of = lambda p: " ".join(map(text_key, p.split()))
    keys = unique(30, 3)
    names = [(rng.choice(keys), f"Division {i:02d}", float(rng.randrange(1, 6))) for i in range(45)]  # several divisions share a key, areas tie
    aliases = {k: f"Alias of {i}" for i, k in enumerate(unique(8, 3))}
    towns = {text_key(rng.choice(vocabulary)): f"Town {i}" for i in range(5)}
    outside = {k: f"Outside {i}" for i, k in enumerate(unique(8, 2))}
    scripts = [("ගොඩගම", "Godagama", 2.0), ("ගොඩගම නගරය", "Godagama Town", 3.0), ("මහරගම", "Maharagama", 1.0), ("මහරගම", "Maharagama West", 0.5)]
    script_aliases = [("කොළඹ", "Fort"), ("ගොඩගම පාර", "Meegoda")]

    def misspelt(p):
        letters = list(p)
        letters[rng.randrange(len(letters))] = rng.choice("aeiou ")
        return "".join(letters)

    texts = set()
    for _ in range(420):
        parts = [rng.choice([
            lambda: phrase(3), lambda: misspelt(phrase(3)), lambda: phrase(2) + rng.choice([" road", " Mawatha", " junction", " town"]), lambda: rng.choice(["Colombo 05", "colombo 7", "12", "near the"]),
            lambda: rng.choice(["ගොඩගම", "ගොඩගම පාර", "මහරගම", "කොළඹ", "ගොඩගම නගරය"]), lambda: misspelt(rng.choice(keys)), lambda: rng.choice(keys).title(),
        ])() for _ in range(rng.randrange(1, 3))]
        texts.add(rng.choice([", ", " "]).join(parts))
    frame = spark.createDataFrame([(t,) for t in sorted(texts)] + [("",), (None,), ("  ",)], "text string")
    pairs = lambda table, a, b: spark.createDataFrame(sorted(table.items()), f"{a} string, {b} string")
    found = matching.resolve_texts(
        frame, "text", spark.createDataFrame(names, "key string, division string, area double"), pairs(aliases, "alias_key", "division"), pairs(towns, "place_key", "district"),
        spark.createDataFrame(scripts, "name string, division string, area double"), pairs(outside, "place_key", "district"), mode="matching",
        script_aliases=spark.createDataFrame(script_aliases, "name string, division string")).collect()
    got = {r["text"]: (r["division"], r["stage"], r["matched"]) for r in found}
    want = {t: plain(t, names, aliases, towns, script_aliases, scripts, outside) for t in texts}
    want = {t: w for t, w in want.items() if w}
    assert len(found) == len(got)
    assert {s for _, s, _ in want.values()} == {"out_of_district", "alias", "script", "exact", "postal", "fuzzy"}
    assert {t: (got.get(t), want.get(t)) for t in got.keys() | want.keys() if got.get(t) != want.get(t)} == {}
