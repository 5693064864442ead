"""Attach one-row statistics (a fitted global aggregate) to every row without a join.

Like a Spark ML estimator's ``fit``: the global aggregate (median, totals, mean/std, min/max)
is computed once as one small job, its single row is read on the driver, and the values
enter the plan as typed literals. No cross join, no repeated subquery evaluation, no
shuffle of the big side; only one row of statistics ever reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_row(df: DataFrame, one_row: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """``df`` plus the columns of ``one_row`` (a global aggregate: exactly one row)."""
    cols = cols or one_row.columns
    stats = one_row.select(*cols)
    types = dict(stats.dtypes)
    row = stats.first()
    if row is None:
        raise ValueError("attach_row expects a one-row statistics frame")
    return df.select("*", *[F.lit(row[c]).cast(types[c]).alias(c) for c in cols])
