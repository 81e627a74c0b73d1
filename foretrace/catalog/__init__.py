"""Registered queries, grouped by family."""

import importlib

FAMILIES = ["windows", "scores", "scalars", "tables", "documents", "ratings", "models", "plans", "streams", "analytics", "serving"]


def _load():
    for family in FAMILIES:
        importlib.import_module(f"foretrace.catalog.{family}")
    from foretrace.catalog import registry

    return registry


def all_queries():
    return dict(_load().QUERIES)


def all_oracles():
    return dict(_load().ORACLES)
