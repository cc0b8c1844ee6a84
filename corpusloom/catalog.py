"""Registered queries of the library and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from corpusloom.plans.adapters import Tables, with_views

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
FAMILIES = ("graph", "mining", "search", "amendments", "reports", "changes", "validation", "streams")


def register(name: str, sql: str | None = None):
    """Registers a function of Tables as a query; its SQL may name the views of the adapters."""

    def add(make: Callable[[Tables], DataFrame]):
        _QUERIES[name] = lambda spark, sf_dir: make(Tables(spark, sf_dir))
        if sql is not None:
            _SQL[name] = with_views(sql)
        return make

    return add


def _load() -> None:
    for family in FAMILIES:
        import_module(f"corpusloom.plans.{family}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
