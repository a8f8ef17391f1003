"""Named queries over the benchmark tables, each with its reference SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from remnant.functions.common import rounded
from remnant.plans.views import Tables

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: the function takes Tables and returns the result before rounding."""

    def add(fn: Callable[[Tables], DataFrame]):
        _QUERIES[name] = lambda spark, path: rounded(fn(Tables(spark, path)))
        if sql is not None:
            _ORACLE[name] = sql
        return fn

    return add


def _load() -> None:
    from remnant.plans import (  # noqa: F401
        behaviour_queries,
        collection_queries,
        item_queries,
        likelihood_queries,
        similarity_queries,
        text_queries,
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)
