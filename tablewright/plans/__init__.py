"""Named queries over the given tables."""

from __future__ import annotations

import importlib

MODULES = (
    "profile_queries", "transform_queries", "text_queries", "evaluation_queries", "answer_queries",
    "type_queries",
)


def load_queries():
    """(queries, sql) with every query module imported."""
    from tablewright.plans import registry

    for module in MODULES:
        importlib.import_module(f"tablewright.plans.{module}")
    return dict(registry.QUERIES), dict(registry.SQL)
