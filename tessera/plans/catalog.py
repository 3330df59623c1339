"""All registered queries. Importing a plan module registers its queries."""

from __future__ import annotations

import importlib

from tessera.plans import registry

MODULES = ["sources", "prepare", "graphs", "ranking", "embedding", "metrics", "validation", "scoring", "robustness",
           "audit", "streams"]


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"tessera.plans.{m}")


def queries() -> dict:
    _load()
    return dict(registry.QUERIES)


def oracle_sql() -> dict:
    _load()
    return dict(registry.ORACLES)
