"""Shared helpers for registered queries."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frauddeck.sources import adapter


def r(c, d: int = 6) -> Column:
    """Round a double for the oracle hash (``+ 0.0`` turns a rounded -0.0 into 0.0)."""
    return F.round(F.col(c) if isinstance(c, str) else c, d) + F.lit(0.0)


def views(spark: SparkSession, sf_dir: str, fact: str = "events") -> dict[str, DataFrame]:
    return adapter.payments_view(spark, sf_dir, fact)


def tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.transactions_from_events(spark, sf_dir)


def ltx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.transactions_from_lineitem(spark, sf_dir)


def joined(spark: SparkSession, sf_dir: str, fact: str = "events", how: str = "left") -> DataFrame:
    from frauddeck.operators.star import star_join
    v = views(spark, sf_dir, fact)
    return star_join(v["transactions"], v["customers"], v["terminals"], v["merchants"], how)


def ts_s(c: str = "TX_TS") -> Column:
    """Timestamp as whole epoch seconds (timestamps are not hashed across engines)."""
    return F.unix_seconds(F.col(c)).alias(c + "_s")


_ = lru_cache  # reserved
