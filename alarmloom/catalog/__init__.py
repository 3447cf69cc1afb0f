"""The registered queries, one module per area."""

from importlib import import_module

from .registry import QUERIES, SQL

AREAS = ["feature_queries", "filter_queries", "ingest_queries", "model_queries"]


def load():
    for area in AREAS:
        import_module(f"{__name__}.{area}")
    return QUERIES, SQL
