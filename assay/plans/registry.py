"""Registered queries: a Spark callable and, where SQL can say the same, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assay.plans.views import VIEWS_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(sql: str) -> str:
    body = sql.strip()
    if body[:5].lower() == "with ":
        return f"with {VIEWS_SQL.strip()},\n{body[5:]}"
    return f"with {VIEWS_SQL.strip()}\n{body}"


def query(name: str, sql: str | None = None):
    """Register the decorated function under ``name``."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn
    return register
