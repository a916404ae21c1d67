"""Character n-gram linear classifier with naive Bayes log-count ratios as feature scales."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelytics.llm.sampling import smallest_hashes

#: Labelled texts that a model is fitted on at most: those whose text hash is smallest, whatever their place in the table.
MAX_TRAINING_TEXTS = 12_000
#: Lengths of the n-grams, size of their hash space, n-grams that become features, and texts a feature occurs in at least.
ORDERS, BITS, FEATURES, LEAST_TEXTS = (3, 4, 5, 6), 22, 4096, 4
#: Smoothing of the counts, weight of the L2 penalty, and steps of the fit.
SMOOTHING, PENALTY, STEPS = 1.0, 2.0, 300
#: Score from which a text is taken as toxic.
CUT = 0.3
_MULTIPLIER, _PORTION = np.uint32(0x01000193), 1_000_000


@dataclass
class Model:
    """`place` gives the feature of an n-gram's hash (-1: none), `weight` its weight times its ratio."""

    place: np.ndarray
    weight: np.ndarray
    bias: float


def _hashed(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of n-grams: hashes at every place of the joined texts, and the text each place belongs to.

    Texts are lower-cased, runs of white space are one blank, and a blank stands at both ends.
    """
    flat = [" " + " ".join(t.lower().split()) + " " for t in texts]
    codes = np.frombuffer("".join(flat).encode("utf-32-le", "replace"), np.uint32)
    sizes = np.fromiter(map(len, flat), np.int64, len(flat))
    owner = np.repeat(np.arange(len(flat), dtype=np.int32), sizes)
    h = np.zeros(len(codes), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(codes) < n:
            return
        h = (h[: len(codes) - n + 1] ^ codes[n - 1 :]) * _MULTIPLIER
        h = h ^ (h >> np.uint32(15))
        if n in ORDERS:
            inside = owner[: len(h)] == owner[n - 1 :]
            yield ((h * np.uint32(2654435769)) >> np.uint32(32 - BITS))[inside], owner[: len(h)][inside]


def _portions(texts: list[str]) -> Iterator[list[str]]:
    at = 0
    while at < len(texts):
        size, to = 0, at
        while to < len(texts) and (to == at or size + len(texts[to]) <= _PORTION):
            size, to = size + len(texts[to]), to + 1
        yield texts[at:to]
        at = to


def _present(texts: list[str], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs without repeats, in order."""
    found = []
    for h, owner in _hashed(texts):
        feature = place[h]
        on = np.flatnonzero(feature >= 0)
        found.append(owner[on].astype(np.int64) * FEATURES + feature[on])
    keys = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
    return keys // FEATURES, keys % FEATURES


def score_texts(texts: list[str], model: Model) -> np.ndarray:
    out = []
    for part in _portions(texts):
        text, feature = _present(part, model.place)
        z = model.bias + np.bincount(text, model.weight[feature], len(part))
        out.append(1 / (1 + np.exp(-np.clip(z, -50, 50))))
    return np.concatenate(out) if out else np.empty(0)


def training_texts(docs: DataFrame, labels: DataFrame, label: str, usable: Column, doc_id: str = "doc_id", text: str = "text", most: int = MAX_TRAINING_TEXTS) -> DataFrame:
    """(text, y) of at most `most` labelled rows for which `usable` (over the id) holds; equal texts become one row.

    y is the mean label of the text's rows. Rows of a null label or id don't count. The rows are those with the smallest
    hash of the id, so that the choice depends neither on order nor on partitions; their table is bounded by `most` and
    therefore broadcast.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.avg(F.col(label).cast("double")).alias("y"))
    known = smallest_hashes(known.filter(usable), F.col(doc_id), most)
    joined = docs.select(F.col(doc_id), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(known), doc_id)
    return joined.groupBy(F.md5("text").alias("k")).agg(F.first("text").alias("text"), F.avg("y").alias("y")).select("text", "y")


def fit(training: DataFrame) -> Model:
    """A model from (text, y).

    Spark counts, for every n-gram hash, the positive and negative texts it occurs in. The log ratio of the smoothed
    shares scales the features; those that tell the classes apart best by chi-square are kept, and a logistic regression
    on presence times ratio is fitted on the bounded rows of `training`. With no positive or no negative text every
    score is the share of positives (0 for an empty table).
    """
    training = training.select("text", (F.col("y") >= 0.5).cast("int").alias("y")).persist()
    totals = training.agg(F.count("*").alias("n"), F.sum("y").alias("p")).first()
    n, p = totals["n"], totals["p"] or 0
    if n == 0 or p in (0, n):
        training.unpersist()
        share = min(max(p / n if n else 0.0, 1e-6), 1 - 1e-6)
        return Model(np.full(1 << BITS, -1, np.int16), np.zeros(FEATURES), float(np.log(share / (1 - share))))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            for y in (0, 1):
                for part in _portions(batch["text"][batch["y"] == y].tolist()):
                    keys = np.unique(np.concatenate([owner.astype(np.int64) << BITS | h for h, owner in _hashed(part)] or [np.empty(0, np.int64)]))
                    seen[y] += np.bincount(keys & ((1 << BITS) - 1), minlength=1 << BITS).astype(np.int32)
        on = np.flatnonzero(seen.any(axis=0))
        for at in range(0, len(on), 200_000):
            part = on[at : at + 200_000]
            yield pd.DataFrame({"h": part, "neg": seen[0, part], "pos": seen[1, part]})

    counts = training.mapInPandas(count, "h int, neg int, pos int").groupBy("h").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    neg, pos, q = F.col("neg"), F.col("pos"), n - p
    chi = F.pow(pos * q - neg * p, 2) * n / ((pos + neg) * (n - pos - neg + 1) * float(p) * float(q))
    chosen = counts.filter(pos + neg >= LEAST_TEXTS).withColumn("chi", chi.cast("double")).orderBy(F.desc("chi"), "h").limit(FEATURES).collect()
    place = np.full(1 << BITS, -1, np.int16)
    place[[r["h"] for r in chosen]] = np.arange(len(chosen))
    ratio = np.zeros(FEATURES)
    for i, r in enumerate(chosen):
        ratio[i] = np.log((r["pos"] + SMOOTHING) / (p + 2 * SMOOTHING)) - np.log((r["neg"] + SMOOTHING) / (q + 2 * SMOOTHING))
    shared = training.sparkSession.sparkContext.broadcast(place)

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for part in _portions(batch["text"].tolist()):
                text, feature = _present(part, shared.value)
                rows += np.split(feature.astype(np.int16), np.searchsorted(text, np.arange(1, len(part))))
            yield pd.DataFrame({"y": batch["y"], "f": [r.tobytes() for r in rows]})

    rows = sorted((r["y"], bytes(r["f"])) for r in training.mapInPandas(sparse, "y int, f binary").collect())
    training.unpersist()
    y = np.array([r[0] for r in rows], float)
    sets = [np.frombuffer(r[1], np.int16) for r in rows]
    text, feature = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets).astype(np.int64)
    weight, bias = _logistic(text, feature, ratio[feature], y)
    return Model(place, weight * ratio, bias)


def _logistic(text: np.ndarray, feature: np.ndarray, value: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """L2-penalised logistic regression on a sparse matrix by accelerated gradient steps of a safe length."""
    n = len(y)
    w = np.zeros(FEATURES + 1)
    # largest eigenvalue of X'X by power iteration, for the step length
    v = np.ones(FEATURES + 1) / np.sqrt(FEATURES + 1)
    top = 1.0
    for _ in range(30):
        z = np.bincount(text, value * v[feature], n) + v[-1]
        g = np.append(np.bincount(feature, value * z[text], FEATURES), z.sum())
        top = float(np.linalg.norm(g)) or 1.0
        v = g / top
    step = 1 / (0.25 * top * 1.05 + PENALTY)
    ahead, momentum = w, 1.0
    for _ in range(STEPS):
        z = np.bincount(text, value * ahead[feature], n) + ahead[-1]
        error = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - y
        g = np.append(np.bincount(feature, value * error[text], FEATURES), error.sum())
        g[:-1] += PENALTY * ahead[:-1]
        new = ahead - step * g
        faster = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = new + (momentum - 1) / faster * (new - w)
        w, momentum = new, faster
    return w[:-1], float(w[-1])


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """`docs` with the score (0 to 1) of each whole text; null counts as the empty text, equal texts score equally.

    An empty text has the score of a text without any feature. A column called like `out` is replaced, other columns
    stay, an empty table gives no rows. The model, a few MB whatever the table, is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(score_texts([t or "" for t in batch], shared.value))

    return docs.withColumn(out, scored(F.col(text)))


def held_out(doc_id: str = "doc_id", remainder: int = 2, folds: int = 4) -> Column:
    """Whether crc32 of the id as text leaves `remainder`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds == remainder


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with held_out, score and predicted (1 from a score of CUT), by a model of the labels that aren't held out."""
    model = fit(training_texts(docs, labels, label, ~held_out(doc_id), doc_id, text))
    return score(docs, model, text).withColumn("held_out", held_out(doc_id)).withColumn("predicted", (F.col("score") >= CUT).cast("int"))
