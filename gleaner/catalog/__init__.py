"""Registered queries over the driver tables, with their DuckDB twins."""

from importlib import import_module

_MODULES = [
    "text_queries", "source_queries", "state_queries", "tag_queries", "report_queries", "page_queries", "stream_queries",
]


def _load():
    for name in _MODULES:
        import_module(f"gleaner.catalog.{name}")
    return import_module("gleaner.catalog.registry")


def queries():
    return dict(_load().QUERIES)


def oracle_sql():
    return dict(_load().ORACLES)
