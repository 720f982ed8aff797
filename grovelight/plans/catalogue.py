"""Everything that is registered: name -> query, name -> SQL."""

from __future__ import annotations

import importlib

_MODULES = ["flat_queries", "prep_queries", "report_queries", "vector_queries", "tree_queries", "quality_queries"]


def _collect(attribute: str) -> dict:
    found: dict = {}
    for name in _MODULES:
        module = importlib.import_module(f".{name}", __package__)
        found.update(getattr(module, attribute))
    return found


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("SQL")
