"""All registered queries of the library with their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
_MODULES = ("text", "taxonomy", "retrieval", "metadata", "clusters", "quality", "ranking", "statistics", "reports", "scoring", "tables")


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` is what DuckDB runs beside it."""

    def put(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return put


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"casebook.plans.{m}_queries")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _SQL
