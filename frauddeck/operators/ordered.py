"""Ordered target statistics of categorical features.

A row's statistic is the smoothed label mean of the rows of its category that come *before* it
in a permutation, so a row's own label never reaches its own feature:
``(positives before + weight * prior) / (rows before + weight)``. Several permutations give
several columns. Rows to score get the statistic of all training rows of their category;
categories that training hasn't seen get the prior.

All columns run together in long form, ``(column, value)`` being one key: one exchange by it,
one sort for each permutation, one exchange back to rows. A key with more than
``rows_per_bucket`` rows (a flag has two such values) is cut into buckets of the permutation,
which are ranges of its order; sums of the buckets before come from a small table joined by
broadcast. It has at most two rows for every ``rows_per_bucket`` rows of input, and the bound
grows with the input so that there are never more than 200,000.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frauddeck.functions import scalars as S

MAX_HOT = 100_000


def permutation(id_col: str, seed: int) -> Column:
    """A place in [0, 1) by a seeded hash of the id."""
    return F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(seed)), 11).cast("double") / float(1 << 53)


def _long(df: DataFrame, cols: list[str], token: str, *keep) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(i).alias("_c"), S.null_token(c, token).alias("_v")) for i, c in enumerate(cols)])
    return df.select(*keep, F.inline(pairs))


def ordered_target_statistics(df: DataFrame, cols: list[str], *, label: str = "TX_FRAUD", id_col: str = "TX_ID", orders: list[Column] | None = None,
                              permutations: int = 4, weight: float = 1.0, prior: float | None = None, token: str = "MISSING", seed: int = 42,
                              rows_per_bucket: int = 1_000_000) -> DataFrame:
    """``(id, <col>_ts<p>...)`` for every row (ids are unique); p counts the permutations from 0.

    ``orders``: columns with values in [0, 1), ties by id; default are seeded hashes of the id. A
    null category is ``token``; rows without a label count nowhere. ``prior`` defaults to the label
    mean. ``rows_per_bucket`` only chooses the plan, never the values.
    """
    orders = orders if orders is not None else [permutation(id_col, seed + p) for p in range(permutations)]
    y = F.col(label).cast("double")
    if prior is None:
        prior = float(df.agg(F.avg(y)).first()[0] or 0.0)
    names = [f"_o{p}" for p in range(len(orders))]
    d = _long(df, cols, token, F.col(id_col), y.alias("_y"), *[o.alias(n) for o, n in zip(orders, names)])
    sizes = d.groupBy("_c", "_v").agg(F.count(F.lit(1)).alias("_n"))
    total = df.count() * len(cols)
    hot, least = None, max(rows_per_bucket, -(-total // MAX_HOT))
    if total > least:
        hot = sizes.where(F.col("_n") > least).select("_c", "_v", F.ceil(2 * F.col("_n") / least).cast("double").alias("_parts")).checkpoint()
        hot = hot if hot.head(1) else None
    if hot is not None:
        d = d.join(F.broadcast(hot), ["_c", "_v"], "left")  # at most MAX_HOT rows
        d = d.withColumns({f"_b{p}": F.when(F.col("_parts").isNull(), 0).otherwise(F.floor(F.col(n) * F.col("_parts"))).cast("int") for p, n in enumerate(names)}).drop("_parts")
    stats = {}
    for p, n in enumerate(names):
        key = ["_c", "_v", *([f"_b{p}"] if hot is not None else [])]
        before = Window.partitionBy(*key).orderBy(n, id_col).rowsBetween(Window.unboundedPreceding, -1)
        s, c = F.coalesce(F.sum("_y").over(before), F.lit(0.0)), F.count("_y").over(before)
        d = d.withColumns({f"_s{p}": s, f"_n{p}": c})
        if hot is not None:
            across = Window.partitionBy("_c", "_v").orderBy(f"_b{p}").rowsBetween(Window.unboundedPreceding, -1)
            earlier = (_long(df, cols, token, y.alias("_y"), orders[p].alias(n)).join(F.broadcast(hot), ["_c", "_v"])
                       .withColumn(f"_b{p}", F.floor(F.col(n) * F.col("_parts")).cast("int")).groupBy(*key).agg(F.sum("_y").alias("_bs"), F.count("_y").alias("_bn"))
                       .select(*key, F.sum("_bs").over(across).alias("_es"), F.sum("_bn").over(across).alias("_en")))
            d = d.join(F.broadcast(earlier), key, "left")  # at most two rows for each `least` rows
            d = d.withColumns({f"_s{p}": F.col(f"_s{p}") + F.coalesce("_es", F.lit(0.0)), f"_n{p}": F.col(f"_n{p}") + F.coalesce("_en", F.lit(0))}).drop("_es", "_en")
        stats[p] = (F.col(f"_s{p}") + weight * prior) / (F.col(f"_n{p}") + weight)
    return d.groupBy(id_col).agg(*[F.max(F.when(F.col("_c") == i, v)).alias(f"{c}_ts{p}") for i, c in enumerate(cols) for p, v in stats.items()])


def fit_target_statistics(df: DataFrame, cols: list[str], *, label: str = "TX_FRAUD", token: str = "MISSING") -> DataFrame:
    """``(column, value, positives, rows)`` of the labelled training rows."""
    d = _long(df, cols, token, F.col(label).cast("double").alias("_y")).where("_y is not null")
    names = F.array(*[F.lit(c) for c in cols])
    return d.groupBy("_c", "_v").agg(F.sum("_y").alias("positives"), F.count(F.lit(1)).alias("rows")).select(names[F.col("_c")].alias("column"), F.col("_v").alias("value"), "positives", "rows")


def apply_target_statistics(df: DataFrame, stats: DataFrame, cols: list[str], prior: float, *, weight: float = 1.0, token: str = "MISSING") -> DataFrame:
    """Rows to score with ``<col>_ts``: their category's statistic over training; unseen: the prior."""
    out = df
    for c in cols:
        own = stats.where(F.col("column") == c).select(F.col("value").alias("_v"), ((F.col("positives") + weight * prior) / (F.col("rows") + weight)).alias("_t"))
        out = out.withColumn("_v", S.null_token(c, token)).join(own, "_v", "left").withColumn(f"{c}_ts", F.coalesce("_t", F.lit(float(prior)))).drop("_v", "_t")
    return out
