"""Plain Python forms of the operators that SQL can't express, over small tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from parcelytics.llm import secrets

# Fixed values of the contract, in Python's syntax.
BASE = (
    ("assign", r"""((?:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    out = []
    for rank, (kind, pattern, group, least) in enumerate(BASE):
        for m in re.finditer(pattern, text, re.ASCII):
            if len(m.group(group)) >= least:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def best_entropy(body: str, window: int) -> float:
    best = 0.0
    for i in range(len(body) - window + 1):
        counts = Counter(body[i : i + window])
        best = max(best, -sum(c / window * math.log2(c / window) for c in counts.values()))
    return best


def entropy_spans(text: str) -> list[tuple[int, int, int, str]]:
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text):
        body = m.group()
        if len(body) < 20 or not re.search("[0-9]", body) or not re.search("[A-Za-z]", body):
            continue
        if any(w in body.lower() for w in secrets.ALLOWED) or re.search(secrets.ALLOWED_SHAPE, body):
            continue
        need = next((bits for _, pattern, bits in secrets.CLASSES if re.fullmatch(pattern.strip("^$"), body)), math.inf)
        if best_entropy(body, secrets.WINDOW) >= need - 1e-12:
            out.append((m.start(), 3, m.end(), "entropy"))
    return out


def secret_row(text: str | None) -> dict:
    text = text or ""
    base = base_spans(text)
    show = lambda rows: ",".join(f"{k}:{s}:{e}" for s, _, e, k in rows)
    count = Counter(k for *_, k in base)
    return {
        "n_assign": count["assign"], "n_access": count["access"], "n_hex": count["hex"],
        "base_sha256": hashlib.sha256(show(base).encode()).hexdigest(), "spans": show(sorted(base + entropy_spans(text))),
    }
