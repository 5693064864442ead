"""Fraud-rate profiling and descriptive statistics.

All reports are grouped aggregations (partial + final hash aggregation) over the fact
table; NULL group keys are dropped first (pandas ``groupby`` semantics, SURVEY N2).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frauddeck.operators import globalrank
from frauddeck.operators.attach import attach_row
from frauddeck.operators.tails import pearson_p_value


def overall_rate(df: DataFrame, label: str = "TX_FRAUD") -> DataFrame:
    """One row: total rows, positives, rate (a ratio, quirk Q13)."""
    return df.agg(F.count(F.lit(1)).alias("n_tx"), F.sum(label).cast("bigint").alias("n_fraud"),
                  F.avg(label).alias("fraud_rate"))


def rate_by(df: DataFrame, dim, label: str = "TX_FRAUD", *, min_count: int = 0,
            top: int | None = None, by_rate: bool = True) -> DataFrame:
    """Count, positives, rate per group with optional support and top-n.

    ``dim`` is a column name or a ``{name: Column}`` dict for a computed key (hour, month...).
    Top-n (the report's feature) orders by rate desc then key, so ties are deterministic.
    """
    if isinstance(dim, dict):
        (name, col), = dim.items()
        d = df.select(col.alias(name), label)
    else:
        name = dim
        d = df.select(dim, label)
    g = (d.filter(F.col(name).isNotNull()).groupBy(name)
          .agg(F.count(F.lit(1)).alias("n_tx"), F.sum(label).cast("bigint").alias("n_fraud"),
               F.avg(label).alias("fraud_rate")))
    if min_count:
        g = g.filter(F.col("n_tx") >= min_count)
    if top:
        g = g.orderBy(F.col("fraud_rate").desc() if by_rate else F.col("n_tx").desc(), F.col(name)).limit(top)
    return g


def positives_share(df: DataFrame, key: str, label: str = "TX_FRAUD") -> DataFrame:
    """Entities with at least one positive and their share of all positives."""
    pos = df.filter(F.col(label) == 1)
    per = pos.groupBy(key).agg(F.count(F.lit(1)).alias("n_fraud"))
    total = pos.agg(F.count(F.lit(1)).alias("_tot"))  # one row
    return attach_row(per, total).select(
        key, "n_fraud", (F.col("n_fraud") / F.col("_tot")).alias("fraud_share"))


def repeat_positive_entities(df: DataFrame, key: str, label: str = "TX_FRAUD", min_pos: int = 2) -> DataFrame:
    """Entities with at least ``min_pos`` positives."""
    return (df.groupBy(key).agg(F.sum(label).cast("bigint").alias("n_fraud"), F.count(F.lit(1)).alias("n_tx"))
              .filter(F.col("n_fraud") >= min_pos))


def amount_buckets(df: DataFrame, amount: str = "TX_AMOUNT", label: str = "TX_FRAUD",
                   width: int = 10, upper: int = 800) -> DataFrame:
    """Right-closed $``width`` buckets on (0, upper]: count, positives, share of positives.

    Bucket i covers (i*w, (i+1)*w] and is labelled ``$i*w-(i*w+w-1)`` (label quirk Q9).
    """
    a = F.col(amount)
    idx = (F.ceil(a / width) - 1).cast("bigint")
    inb = (a > 0) & (a <= upper)
    d = df.filter(inb).select(idx.alias("bucket"), label)
    total_pos = df.filter(inb).agg(F.sum(label).alias("_tp"))
    g = d.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_tx"), F.sum(label).cast("bigint").alias("n_fraud"))
    return attach_row(g, total_pos).select(
        F.concat(F.lit("$"), (F.col("bucket") * width).cast("string"), F.lit("-"),
                 (F.col("bucket") * width + width - 1).cast("string")).alias("amount_bucket"),
        "bucket", "n_tx", "n_fraud", (F.col("n_fraud") / F.col("_tp") * 100).alias("fraud_contribution"))


def cut_right(c: Column, edges: list[float], labels: list[str]) -> Column:
    """``pd.cut`` with right-closed bins: (e0,e1], (e1,e2], ...; outside -> NULL."""
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (c > lo) & (c <= hi) if not math.isinf(hi) else (c > lo)
        expr = F.when(cond, lab) if expr is None else expr.when(cond, lab)
    return expr


# The amount and distance bands of the profiling report.
AMOUNT_EDGES = [0, 10, 50, 100, 200, 500, 1000, 2000, float("inf")]
AMOUNT_LABELS = ["<10", "10-50", "50-100", "100-200", "200-500", "500-1000", "1000-2000", ">2000"]
DISTANCE_EDGES = [0, 5, 10, 20, 50, 100, float("inf")]
DISTANCE_LABELS = ["<5", "5-10", "10-20", "20-50", "50-100", ">100"]


def rate_by_bins(df: DataFrame, value: str, edges, labels, out: str, label: str = "TX_FRAUD") -> DataFrame:
    """Rate per right-closed band; rows outside every band are dropped."""
    return rate_by(df, {out: cut_right(F.col(value), edges, labels)}, label)


def histogram(df: DataFrame, value: str, bins: int = 50, *, by: str | None = None) -> DataFrame:
    """Equal-width histogram over [min, max] with counts and density, optional class split.

    bin = least(floor((x - min) / width), bins - 1); density = count / (n * width).
    """
    rng = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    d = attach_row(df.filter(F.col(value).isNotNull()), rng)
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1))).cast("bigint")
    keys = [by] if by else []
    g = d.select(*keys, b.alias("bin"), "_lo", "_hi").groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
    tot = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_tot")) if by else d.agg(F.count(F.lit(1)).alias("_tot"))
    g = g.join(tot, keys) if by else attach_row(g, tot)
    w = (F.col("_hi") - F.col("_lo")) / bins
    return g.select(*keys, "bin", (F.col("_lo") + F.col("bin") * w).alias("bin_left"),
                    (F.col("_lo") + (F.col("bin") + 1) * w).alias("bin_right"), "n",
                    F.when(w > 0, F.col("n") / (F.col("_tot") * w)).alias("density"))


def dataset_summary(df: DataFrame, amount: str = "TX_AMOUNT", label: str = "TX_FRAUD") -> DataFrame:
    """Totals, means, exact median, class means, distinct entities, time range."""
    a, y = F.col(amount), F.col(label)
    med = globalrank.exact_quantile(df, amount, 0.5).select(F.col(f"q_{amount}").alias("median_amount"))
    main = df.agg(
        F.count(F.lit(1)).alias("n_tx"), F.sum(label).cast("bigint").alias("n_fraud"),
        F.avg(label).alias("fraud_rate"), F.avg(a).alias("mean_amount"),
        F.avg(F.when(y == 1, a)).alias("mean_fraud_amount"), F.avg(F.when(y == 0, a)).alias("mean_legit_amount"),
        F.min("TX_TS").alias("first_ts"), F.max("TX_TS").alias("last_ts"))
    # one distinct count at a time: together they would expand every row fourfold
    for key, name in (("CUSTOMER_ID", "n_customers"), ("TERMINAL_ID", "n_terminals"), ("MERCHANT_ID", "n_merchants")):
        main = attach_row(main, df.agg(F.count_distinct(key).alias(name)))
    return attach_row(main, med)


def entity_amount_profile(df: DataFrame, key: str, amount: str = "TX_AMOUNT", *,
                          with_median: bool = True) -> DataFrame:
    """Count, mean, std, min, max (and exact median) of the amount per entity."""
    p = key.split("_")[0].lower()
    g = df.groupBy(key).agg(F.count(amount).alias(f"{p}_amt_count"), F.avg(amount).alias(f"{p}_amt_mean"),
                            F.stddev_samp(amount).alias(f"{p}_amt_std"), F.min(amount).alias(f"{p}_amt_min"),
                            F.max(amount).alias(f"{p}_amt_max"))
    if with_median:
        med = globalrank.exact_quantile(df, amount, 0.5, keys=[key]).withColumnRenamed(
            f"q_{amount}", f"{p}_amt_median")
        g = g.join(med, key, "left")
    return g


def entity_fraud_profile(df: DataFrame, key: str, label: str = "TX_FRAUD") -> DataFrame:
    """Per-entity fraud rate and fraud count (NULL labels count as 0)."""
    p = key.split("_")[0].lower()
    y = F.coalesce(F.col(label), F.lit(0))
    return df.groupBy(key).agg(F.avg(y).alias(f"{p}_fraud_rate"), F.sum(y).cast("bigint").alias(f"{p}_fraud_count"))


def distinct_values(tables: dict[str, DataFrame], columns: list[str], max_list: int = 20) -> DataFrame:
    """Distinct values of categorical columns across several tables.

    One unpivot per table into ``(column, value)`` strings, union, distinct; per column the
    count, min, max and the sorted list only when it has at most ``max_list`` values. The list
    is built from the values ranked within their column, so no unbounded set is collected.
    """
    parts = []
    for df in tables.values():
        present = [c for c in columns if c in df.columns]
        if not present:
            continue
        parts.append(df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in present
        ])).alias("kv")).select("kv.column", "kv.value"))
    u = parts[0]
    for p_ in parts[1:]:
        u = u.unionByName(p_)
    dv = u.filter(F.col("value").isNotNull()).distinct()
    g = dv.groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"), F.min("value").alias("first_value"),
                                 F.max("value").alias("last_value"))
    # only columns with at most ``max_list`` values get a list: semi-join to that (tiny) column
    # list first, so no high-cardinality column is ever gathered or sorted in one task
    few = g.filter(F.col("n_distinct") <= max_list).select("column")
    small = (dv.join(F.broadcast(few), "column", "left_semi").groupBy("column")
               .agg(F.array_join(F.sort_array(F.collect_list("value")), "|").alias("values")))
    return g.join(small, "column", "left").select("column", "n_distinct", "first_value", "last_value", "values")


def compromised_entities(df: DataFrame, key: str = "TERMINAL_ID", label: str = "TX_FRAUD", *,
                         min_count: int = 5, threshold: float = 1.0) -> DataFrame:
    """Entities with >= ``min_count`` rows and fraud rate >= ``threshold``."""
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias("n_tx"), F.sum(label).cast("bigint").alias("n_fraud"),
                                F.avg(label).alias("fraud_rate"))
              .filter((F.col("n_tx") >= min_count) & (F.col("fraud_rate") >= threshold)))


def spatial_cells(df: DataFrame, x: str, y: str, label: str = "TX_FRAUD", *, min_support: int = 3,
                  exclude: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """Per grid cell (x, y): count, rate, log1p(rate), support >= ``min_support``.

    ``exclude`` (with ``key``) removes known compromised entities first (anti join).
    """
    d = df
    if exclude is not None and key:
        d = d.join(exclude.select(key), key, "left_anti")
    return (d.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
             .groupBy(x, y).agg(F.count(F.lit(1)).alias("n_tx"), F.avg(label).alias("fraud_rate"))
             .filter(F.col("n_tx") >= min_support)
             .withColumn("log_fraud_rate", F.log1p("fraud_rate")))


def conditional_rates(df: DataFrame, flags: list[str], label: str = "TX_FRAUD") -> DataFrame:
    """Fraud rate when each flag is 1 and when it is 0: one aggregation for all flags."""
    y = F.col(label)
    wide = df.agg(*[F.struct(F.lit(f).alias("flag"), F.avg(F.when(F.col(f).cast("int") == 1, y)).alias("rate_when_1"),
                             F.avg(F.when(F.col(f).cast("int") == 0, y)).alias("rate_when_0"),
                             F.count_if(F.col(f).cast("int") == 1).alias("n_when_1")).alias(f"s{i}") for i, f in enumerate(flags)])
    return wide.select(F.inline(F.array(*[f"s{i}" for i in range(len(flags))])))


def label_correlations(df: DataFrame, features: list[str], label: str = "TX_FRAUD",
                       min_non_null: int = 100) -> DataFrame:
    """Pearson r of each feature (NULL -> 0) with the label, and its two-sided p-value.

    One aggregation computes every r and non-null count; features with at most
    ``min_non_null`` non-null values are dropped.
    """
    y = F.col(label).cast("double")
    aggs = []
    for f in features:
        aggs += [F.corr(F.coalesce(F.col(f).cast("double"), F.lit(0.0)), y).alias(f"r__{f}"),
                 F.count(f).alias(f"n__{f}")]
    wide = df.agg(*aggs, F.count(F.lit(1)).alias("_rows"))
    long = wide.select("_rows", F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"r__{f}").alias("correlation"),
                 F.col(f"n__{f}").alias("non_null")) for f in features])).alias("s")).select("_rows", "s.*")
    return (long.filter((F.col("non_null") > min_non_null) & F.col("correlation").isNotNull())
                .select("feature", "correlation", F.abs("correlation").alias("abs_correlation"),
                        F.col("_rows").alias("n"), pearson_p_value(F.col("correlation"), F.col("_rows")).alias("p_value")))


def percentile_flag(df: DataFrame, value: str, q: float = 0.95, out: str = "is_top_pct") -> DataFrame:
    """Exact cutoff at quantile ``q`` and a flag for rows above it."""
    cut = globalrank.exact_quantile(df, value, q).select(F.col(f"q_{value}").alias("_cut"))
    return (attach_row(df, cut)
              .withColumn(out, (F.col(value) > F.col("_cut")).cast("int")).withColumnRenamed("_cut", f"{out}_cutoff"))


def describe(df: DataFrame, value: str) -> DataFrame:
    """Count, mean, std, min, quartiles (exact, linear), max."""
    base = df.agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
                  F.min(value).alias("min"), F.max(value).alias("max"))
    return attach_row(base, globalrank.exact_quantiles(df, value, {"p25": 0.25, "p50": 0.5, "p75": 0.75}))


def mean_by(df: DataFrame, dim, value: str, out: str = "mean_score") -> DataFrame:
    """Mean of a score per group."""
    if isinstance(dim, dict):
        (name, col), = dim.items()
        d = df.select(col.alias(name), value)
    else:
        name, d = dim, df.select(dim, value)
    return d.filter(F.col(name).isNotNull()).groupBy(name).agg(F.avg(value).alias(out), F.count(F.lit(1)).alias("n"))


def prediction_summary(df: DataFrame, pred: str) -> DataFrame:
    """Total, negatives, positives, positive rate (percent)."""
    p = F.col(pred)
    return df.agg(F.count(F.lit(1)).alias("n_total"), F.sum(F.when(p == 0, 1).otherwise(0)).cast("bigint").alias("n_neg"),
                  F.sum(F.when(p == 1, 1).otherwise(0)).cast("bigint").alias("n_pos"),
                  (F.avg(F.when(p == 1, 1.0).otherwise(0.0)) * 100).alias("pos_rate_pct"))


def score_moments(df: DataFrame, score: str) -> DataFrame:
    """Mean, max, sample std of a score."""
    return df.agg(F.avg(score).alias("mean"), F.max(score).alias("max"), F.stddev_samp(score).alias("std"))


def positive_amount_moments(df: DataFrame, amount: str = "TX_AMOUNT", label: str = "TX_FRAUD") -> DataFrame:
    """Mean, population std, min, max of amounts of positive rows (:mod:`frauddeck.operators.tails` has
    the truncated normal)."""
    pos = df.filter(F.col(label) == 1)
    return pos.agg(F.avg(amount).alias("mu"), F.stddev_pop(amount).alias("sigma"),
                   F.min(amount).alias("lo"), F.max(amount).alias("hi"), F.count(F.lit(1)).alias("n"))


def top_n(df: DataFrame, order: list, n: int) -> DataFrame:
    """Top-n rows; Spark plans ``orderBy + limit`` as TakeOrderedAndProject."""
    return df.orderBy(*order).limit(n)
