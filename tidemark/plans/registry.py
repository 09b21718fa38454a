"""Queries by name. ``sql`` is None where SQL can't say it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


MODULES = ("series_queries", "cross_queries", "asof_queries", "text_queries", "sim_queries", "strategy_queries", "source_queries", "research_queries", "evaluation_queries", "feed_queries", "bitemporal_queries", "master_queries")


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"{__package__}.{m}")


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return QUERIES


def all_sql() -> dict[str, str]:
    _load()
    return ORACLE_SQL


def r(expr: str, dp: int = 4) -> str:
    """half_up in SQL."""
    return f"(floor(({expr}) * 1e{dp} + 0.5) / 1e{dp})"
