"""Registered queries: name -> (spark, sf_dir) -> DataFrame, plus oracle SQL.

Each query builds the model tables from the test data of ``sf_dir`` and
runs one operator over all of them.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bodega.sources.fixtures import AS_OF, Fixture

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Callable[[Fixture], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Fixture(spark, sf_dir, AS_OF))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from bodega.plans import (q_changes, q_io, q_listings, q_migration,  # noqa: F401
                              q_order_log, q_posting, q_reports)
