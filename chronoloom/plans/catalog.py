"""Registry of the library's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}
MODULES = ("curves", "spans", "joins", "metrics", "ranks", "sequences", "selection", "texts", "thresholds", "graphs", "models", "records", "segments", "streams", "policies", "studies", "tokens", "variants")


def query(name: str, sql: str | None = None):
    """Register the decorated function as a query; ``sql`` is its DuckDB equivalent."""

    def register(f: Query) -> Query:
        _queries[name] = f
        if sql:
            _sql[name] = sql
        return f

    return register


def _load() -> None:
    for module in MODULES:
        import_module(f"chronoloom.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
