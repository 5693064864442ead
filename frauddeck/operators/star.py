"""Star joins and score-file alignment.

Dimension tables are joined with plain equi-joins. No blind ``broadcast()`` hint is
used on them: dimensions grow with the business (millions of customers at scale), so the
choice is left to Catalyst's size-checked ``autoBroadcastJoinThreshold`` and to AQE, which
re-plans to a broadcast join from the measured size of a finished stage, and splits
skewed partitions of a sort-merge join otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def star_join(tx: DataFrame, customers: DataFrame | None = None, terminals: DataFrame | None = None,
              merchants: DataFrame | None = None, how: str = "left") -> DataFrame:
    """C1 (``how='left'``) / C2 (``how='inner'``): transactions with their dimensions.

    NULL keys never match (pandas would match NaN with NaN, SURVEY N3).
    """
    out = tx
    if merchants is not None:
        out = out.join(merchants, "MERCHANT_ID", how)
    if customers is not None:
        out = out.join(customers, "CUSTOMER_ID", how)
    if terminals is not None:
        out = out.join(terminals, "TERMINAL_ID", how)
    return out


def packed(dim: DataFrame, key: str, out: str) -> DataFrame:
    """One row for each key with the dimension's rows in an array ``out``, so that joining it never adds rows."""
    return dim.groupBy(key).agg(F.collect_list(F.struct(*[F.col(c) for c in dim.columns if c != key])).alias(out))


def unpacked(df: DataFrame, arrays: list[str]) -> DataFrame:
    """The columns of :func:`packed` arrays, a row for each of their rows as a left join has them."""
    for a in arrays:
        df = df.select(*[F.col(c) for c in df.columns if c != a], F.inline_outer(a))
    return df


def dim_with_fact_counts(dim: DataFrame, fact: DataFrame, key: str, *, label: str = "TX_FRAUD",
                         plus_one: bool = False) -> DataFrame:
    """Every dimension row with its fact count and positives (NULL -> 0, optional +1)."""
    agg = fact.groupBy(key).agg(F.count(F.lit(1)).alias("n_tx"), F.sum(label).cast("bigint").alias("n_fraud"))
    j = dim.join(agg, key, "left")
    add = 1 if plus_one else 0
    return j.withColumns({"n_tx": F.coalesce("n_tx", F.lit(0)) + add,
                          "n_fraud": F.coalesce("n_fraud", F.lit(0)) + add})


def align_scores(a: DataFrame, b: DataFrame, *, id_col: str = "TX_ID", score: str = "TX_FRAUD",
                 suffixes: tuple[str, str] = ("_a", "_b"), require_overlap: bool = False) -> DataFrame:
    """C4: inner join of two score files on the id with suffixed score columns.

    ``require_overlap`` raises when no id is shared (the comparison tool's behaviour); it costs
    one small action.
    """
    for df in (a, b):
        missing = [c for c in (id_col, score) if c not in df.columns]
        if missing:
            raise ValueError(f"score file lacks required columns: {missing}")  # A4
    j = (a.select(id_col, F.col(score).alias(score + suffixes[0]))
          .join(b.select(id_col, F.col(score).alias(score + suffixes[1])), id_col, "inner"))
    if require_overlap and j.limit(1).count() == 0:
        raise ValueError("the two score files share no id")
    return j


def labels_and_scores(labels: DataFrame, a: DataFrame, b: DataFrame, *, id_col: str = "TX_ID",
                      label: str = "TX_FRAUD") -> DataFrame:
    """Labels joined with two score files (``p_a``, ``p_b``)."""
    return (labels.select(id_col, F.col(label).alias("y"))
            .join(a.select(id_col, F.col(label).alias("p_a")), id_col)
            .join(b.select(id_col, F.col(label).alias("p_b")), id_col))


def lookup_from_reference(rows: DataFrame, reference: DataFrame, key: str, aggs: dict,
                          defaults: dict | None = None) -> DataFrame:
    """Statistics computed on a reference frame (train) attached to other rows (test)."""
    stats = reference.groupBy(key).agg(*[c.alias(n) for n, c in aggs.items()])
    out = rows.join(stats, key, "left")
    if defaults:
        out = out.withColumns({n: F.coalesce(F.col(n), F.lit(v)) for n, v in defaults.items()})
    return out


def membership_flag(df: DataFrame, ids: DataFrame, key: str, out: str) -> DataFrame:
    """1 when the key is in ``ids`` (a computed id set), else 0."""
    flag = ids.select(key).distinct().withColumn(out, F.lit(1))
    return df.join(flag, key, "left").withColumn(out, F.coalesce(F.col(out), F.lit(0)))


def anti_filter(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``ids``."""
    return df.join(ids.select(key), key, "left_anti")


def concat_blocks(blocks: list[DataFrame], id_col: str = "TX_ID") -> DataFrame:
    """Feature blocks of the same rows side by side, joined on the id (unique in each block).

    Rows that a block lacks have nulls in its columns. A column name that two blocks share is an
    error, as it would be lost or doubled.
    """
    seen: dict[str, int] = {}
    for i, b in enumerate(blocks):
        for c in b.columns:
            if c != id_col and c.lower() in seen:
                raise ValueError(f"blocks {seen[c.lower()]} and {i} both have a column {c}")
            seen[c.lower()] = i
    out = blocks[0]
    for b in blocks[1:]:
        out = out.join(b, id_col, "full")
    return out
