"""Registry of the runnable queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bindings import Evidence, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, recursive: bool = False):
    """Register ``fn(evidence) -> DataFrame`` under a name, with its SQL counterpart."""
    def register(fn):
        QUERIES[name] = lambda spark, folder: fn(Evidence(spark, folder))
        if sql is not None:
            ORACLES[name] = oracle(sql, recursive)
        return fn
    return register
