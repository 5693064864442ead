"""Registry of named queries: a Spark builder and (where SQL can say it) a DuckDB oracle.

Builders take ``(spark, sf_dir)`` and return a DataFrame over the whole input tables.
Doubles are rounded in both the builder and the oracle so that value hashes agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from frauddeck.plans.oracle import with_view

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_view(sql)
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from frauddeck.plans import (q_clean, q_encode, q_metrics, q_pipelines,  # noqa: F401
                                 q_profile, q_scalars, q_tables, q_windows)
