"""Every operator as a runnable query over the given tables, with its oracle SQL where SQL can say it."""

from __future__ import annotations

import importlib

from lumbrera.queries import registry

MODULES = ("review", "text", "rules", "metrics", "lifecycle", "qa", "formats", "streams")


def load() -> dict[str, registry.Query]:
    for module in MODULES:
        importlib.import_module(f"lumbrera.queries.{module}")
    return registry.QUERIES


def load_oracles() -> dict[str, str]:
    load()
    return dict(registry.ORACLES)
