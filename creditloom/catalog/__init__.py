"""All registered queries."""

from __future__ import annotations

from importlib import import_module

from creditloom.catalog.base import Catalog

MODULES = ["features", "profile", "graphs", "learning"]


def load() -> Catalog:
    merged = Catalog()
    for module in MODULES:
        for name, query in import_module(f"creditloom.catalog.{module}").catalog.items():
            merged.add(name, query.job, query.sql)
    return merged
