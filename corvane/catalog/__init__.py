"""Every registered query of the query surface, with the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}
_MODULES = ("relational", "addresses", "retrieval", "search", "memory", "sources", "surface", "streams")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name and, if given, its SQL."""

    def add(function: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = function
        if sql:
            _ORACLE[name] = sql
        return function

    return add


def _load() -> None:
    for name in _MODULES:
        import_module(f"{__name__}.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)
