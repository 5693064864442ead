"""Splits, folds and weights.

Random order comes from a seeded hash of the id (``xxhash64`` by default, or any integer
expression the caller passes), so splits are repeatable and need no driver state. All
ranks use the distributed running count, never a single-partition window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frauddeck.operators import globalrank
from frauddeck.operators.attach import attach_row


def seeded_key(id_col: str, seed: int = 42) -> Column:
    return F.xxhash64(F.col(id_col), F.lit(seed))


def _narrow_rank(df: DataFrame, keys: list[str], order: list[Column], id_col: str, extra: dict | None = None) -> DataFrame:
    """Rank a narrow ``(id, keys, order)`` projection (checkpointed by the rank helper) and
    return ``(id, _r, _r_n)``; callers join it back on the id, so the wide rows are shuffled
    once and never checkpointed."""
    cols = {id_col: F.col(id_col), **{k: F.col(k) for k in keys}, **(extra or {})}
    narrow = df.select(*[c.alias(n) for n, c in cols.items()])
    r = globalrank.row_number_within(narrow, keys, order, out="_r")
    if not keys:
        r = attach_row(r, narrow.agg(F.count(F.lit(1)).alias("_r_n")))
    return r.select(id_col, "_r", "_r_n")


def stratified_split(df: DataFrame, *, label: str = "TX_FRAUD", id_col: str = "TX_ID", train_frac: float = 0.8,
                     shuffle_key: Column | None = None, out: str = "is_train") -> DataFrame:
    """Per class, the first ``floor(train_frac * n_class)`` rows in hash order are train."""
    key = shuffle_key if shuffle_key is not None else seeded_key(id_col)
    r = _narrow_rank(df, [label], [F.col("_sk"), F.col(id_col)], id_col, {"_sk": key})
    r = r.select(id_col, (F.col("_r") <= F.floor(F.col("_r_n") * train_frac)).cast("int").alias(out))
    return df.join(r, id_col)


def time_split(df: DataFrame, *, ts: str = "TX_TS", id_col: str = "TX_ID", train_frac: float = 0.8,
               out: str = "is_train") -> DataFrame:
    """The earliest ``floor(train_frac * n)`` rows by (ts, id) are train, the rest validation."""
    r = _narrow_rank(df, [], [F.col(ts), F.col(id_col)], id_col, {ts: F.col(ts)})
    r = r.select(id_col, (F.col("_r") <= F.floor(F.col("_r_n") * train_frac)).cast("int").alias(out))
    return df.join(r, id_col)


def stratified_kfold(df: DataFrame, k: int = 5, *, label: str = "TX_FRAUD", id_col: str = "TX_ID",
                     shuffle_key: Column | None = None, out: str = "fold") -> DataFrame:
    """fold = (rank within class in hash order - 1) mod k: class-balanced folds."""
    key = shuffle_key if shuffle_key is not None else seeded_key(id_col)
    r = _narrow_rank(df, [label], [F.col("_sk"), F.col(id_col)], id_col, {"_sk": key})
    return df.join(r.select(id_col, F.pmod(F.col("_r") - 1, F.lit(k)).cast("int").alias(out)), id_col)


def time_folds(df: DataFrame, k: int = 5, *, ts: str = "TX_TS", id_col: str = "TX_ID", out: str = "fold") -> DataFrame:
    """Contiguous time folds; the first ``n % k`` folds get one extra row.

    Fold ``f`` is validated on its rows and trained on all rows of folds < f (fold 0 has
    no training rows and is skipped by callers, quirk Q14).
    """
    r = _narrow_rank(df, [], [F.col(ts), F.col(id_col)], id_col, {ts: F.col(ts)})
    p = F.col("_r") - 1
    q = F.floor(F.col("_r_n") / k)
    rem = F.col("_r_n") - q * k
    boundary = rem * (q + 1)
    fold = F.when(p < boundary, F.floor(p / (q + 1))).otherwise(rem + F.floor((p - boundary) / q))
    return df.join(r.select(id_col, fold.cast("int").alias(out)), id_col)


def class_weight(df: DataFrame, label: str = "TX_FRAUD", factor: float = 1.0) -> DataFrame:
    """One row ``neg/pos`` (at least 1) times ``factor`` (0.7 variant)."""
    y = F.col(label)
    a = df.agg(F.sum(F.when(y == 0, 1).otherwise(0)).alias("n_neg"), F.sum(F.when(y == 1, 1).otherwise(0)).alias("n_pos"))
    w = F.greatest(F.col("n_neg") / F.greatest(F.col("n_pos"), F.lit(1)), F.lit(1.0)) * factor
    return a.select(F.col("n_neg").cast("bigint").alias("n_neg"), F.col("n_pos").cast("bigint").alias("n_pos"),
                    w.alias("scale_pos_weight"))


def with_class_weight_col(df: DataFrame, label: str = "TX_FRAUD", out: str = "weight", factor: float = 1.0, *,
                          fitted: DataFrame | None = None) -> DataFrame:
    """J5 as a ``weightCol``: positives weighted ``neg/pos`` (of ``fitted``, a :func:`class_weight` of other
    rows, if given), negatives 1."""
    w = (fitted if fitted is not None else class_weight(df, label, factor)).select("scale_pos_weight")
    return (attach_row(df, w)
              .withColumn(out, F.when(F.col(label) == 1, F.col("scale_pos_weight")).otherwise(F.lit(1.0)))
              .drop("scale_pos_weight"))
