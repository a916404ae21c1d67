"""All registered queries and their SQL counterparts."""

from __future__ import annotations

import importlib
import pkgutil


def load_all() -> tuple[dict, dict]:
    from parcelytics.catalog import registry

    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        if module.startswith("queries_"):
            importlib.import_module(f"{__name__}.{module}")
    return dict(registry.QUERIES), dict(registry.ORACLES)
