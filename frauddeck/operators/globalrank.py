"""Distributed global order: prefix sums, average ranks and exact quantiles.

A window without ``partitionBy`` sends every row to one task. Instead:

1. range-partition the (usually pre-aggregated) rows on the order columns, tag each row
   with its range partition id and cut lineage with ``checkpoint()`` so both passes below
   see the same partition boundaries;
2. sum the weights per range partition (``#partitions`` rows) and turn them into
   partition offsets with a window over that tiny table;
3. broadcast the offsets (size bounded by the partition count) and add a window running
   sum inside each range partition.

Equal order values always fall into one range partition, so ties stay together.
Callers pre-aggregate ties (``groupBy(value)``) first, which also removes hot-value skew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frauddeck.session import ensure_checkpoint_dir


def default_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def prefix_sums(df: DataFrame, order: list, sums: list[str], *, n_parts: int | None = None,
                prefix: str = "_cum_", totals: bool = False) -> DataFrame:
    """Add inclusive running sums ``{prefix}{c}`` of ``sums`` in the total order ``order``.

    ``order`` must be a total order (unique rows) for the running sums to be deterministic.
    ``totals`` also adds the grand totals ``_grp{c}`` from the (tiny) partition-offset table,
    which saves a second pass over the data.
    """
    ensure_checkpoint_dir(df.sparkSession)
    n = n_parts or default_parts(df)
    ranged = (df.repartitionByRange(n, *order)
                .withColumn("_pid", F.spark_partition_id())
                .checkpoint(eager=True))
    per_part = ranged.groupBy("_pid").agg(*[F.sum(c).alias(c) for c in sums])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = per_part.select("_pid", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_off_{c}")
                                        for c in sums],
                              *[F.sum(c).over(everything).alias(f"_grp{c}") for c in sums])
    local = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(offsets), "_pid")
    return out.select(*df.columns,
                      *[(F.col(f"_off_{c}") + F.sum(c).over(local)).alias(f"{prefix}{c}") for c in sums],
                      *([F.col(f"_grp{c}") for c in sums] if totals else []))


def value_counts_ranked(df: DataFrame, value: str, *, keys: list[str] = (), descending: bool = False,
                        extra_sums: dict[str, Column] | None = None, weight: Column | None = None) -> DataFrame:
    """Distinct ``(keys, value)`` with ``_n`` rows each plus running counts inside ``keys``.

    ``weight`` (default 1) is the number of rows that a row stands for.

    Output columns: keys, value, ``_n``, extra sums, ``_cum__n`` (rows up to and including this
    value inside its key group), ``_grp_n`` (rows in the key group) and ``_cum_<extra>``.
    """
    keys = list(keys)
    aggs = [(F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_n")] + [c.alias(k) for k, c in (extra_sums or {}).items()]
    d = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(*aggs)
    vord = F.col(value).desc() if descending else F.col(value).asc()
    sums = ["_n"] + list((extra_sums or {}).keys())
    if not keys:
        return prefix_sums(d, [vord], sums, totals=True)
    ranked = prefix_sums(d, [*[F.col(k) for k in keys], vord], sums)
    # subtract the running total reached before each key group starts
    grp = ranked.groupBy(*keys).agg(*[(F.min(F.col(f"_cum_{c}") - F.col(c))).alias(f"_start{c}") for c in sums],
                                    *[F.sum(c).alias(f"_grp{c}") for c in sums])
    j = ranked.join(grp, keys)
    return j.select(*keys, value, *sums,
                    *[(F.col(f"_cum_{c}") - F.col(f"_start{c}")).alias(f"_cum_{c}") for c in sums],
                    *[F.col(f"_grp{c}") for c in sums])


#: Stands for null among the bits of doubles; no NaN that :func:`bits_of` returns has it.
NULL_BITS = -1


def bits_of(values: pa.Array) -> np.ndarray:
    """Doubles as whole numbers that are equal where the values are: zeros of both signs, NaN, null."""
    v = values.fill_null(0.0).to_numpy(zero_copy_only=False) + 0.0
    v[np.isnan(v)] = np.nan
    bits = v.view(np.int64)
    bits[values.is_null().to_numpy(zero_copy_only=False)] = NULL_BITS
    return bits


def ties_together(k: np.ndarray, bits: np.ndarray, pos: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows that lie by ``(k, bits)``, one for each pair, with its positives and rows."""
    if not len(k):
        return k, bits, pos, n
    at = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (bits[1:] != bits[:-1])]))
    return k[at], bits[at], np.add.reduceat(pos, at), np.add.reduceat(n, at)


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a range's rows, sorted by value: each value that has positives, with the running counts of its key in the
    range, and at last a row with the totals of each key. A value may go on in the next batch, so the last one of
    each key is held."""
    pid, before = TaskContext.get().partitionId(), {}  # key -> positives and rows ahead of the held value
    held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))

    def out(k, own, cum_pos, cum_n, last):
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.full(len(k), pid, np.int32)), pa.array(own), pa.array(cum_pos), pa.array(cum_n), pa.array(np.full(len(k), last))],
                                          names=["_k", "_pid", "_pos", "_cum_pos", "_cum_n", "_last"])

    def counted(rows):
        k, _, own, n = rows
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        sizes = np.diff([*starts, len(k)])
        cum = []
        for x, i in ((own, 0), (n, 1)):
            c = np.cumsum(x)
            cum.append(c + np.repeat([before.get(key, (0, 0))[i] for key in k[starts].tolist()] - (c - x)[starts], sizes))
        return starts + sizes - 1, cum

    for b in batches:
        if b.num_rows:
            k, v, p, c = b.columns
            new = (k.to_numpy(), bits_of(v), p.to_numpy(), c.to_numpy())
            rows = [np.concatenate(x) for x in zip(held, new)]
            order = np.argsort(rows[0], kind="stable")
            rows = ties_together(*[x[order] for x in rows])
            ends, (pos, n) = counted(rows)
            some = rows[2] != 0
            some[ends] = False
            yield out(rows[0][some], rows[2][some], pos[some], n[some], False)
            held = tuple(x[ends] for x in rows)
            before = {key: (x, y) for key, x, y in zip(held[0].tolist(), (pos[ends] - held[2]).tolist(), (n[ends] - held[3]).tolist())}
    if len(held[0]):
        _, (pos, n) = counted(held)
        some = held[2] != 0
        yield out(held[0][some], held[2][some], pos[some], n[some], False)
        yield out(held[0], np.zeros(len(pos)), pos, n, True)


def average_precisions(df: DataFrame, key: str, score: str, pos: str, n: str) -> DataFrame:
    """``(key, average_precision)``: step AP of the scores of each whole-numbered key, ties together, null without
    a positive. A row stands for ``n`` rows with ``pos`` positives; null scores are the lowest.

    Rows are shuffled once, by ranges of ``(key, score)``, and sorted by score; a task adds up ties and keeps
    the values with positives and their running counts in the range. The counts of earlier ranges (one
    row for each range and key) are added when the terms are summed.
    """
    ensure_checkpoint_dir(df.sparkSession)
    rows = df.select(F.col(key).cast("long").alias("_k"), (F.col(score) + F.lit(0.0)).alias("_v"),
                     F.coalesce(F.col(pos).cast("double"), F.lit(0.0)).alias("_pos"), F.col(n).cast("long").alias("_n"))
    falling = F.col("_v").desc_nulls_last()  # one column, so that Spark sorts by radix
    ranged = (rows.repartitionByRange(default_parts(df), "_k", falling).sortWithinPartitions(falling)
              .mapInArrow(_running, "_k long, _pid int, _pos double, _cum_pos double, _cum_n long, _last boolean").checkpoint(eager=True))
    own = Window.partitionBy("_k")
    before = own.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.where("_last").select("_k", "_pid", F.sum("_cum_pos").over(own).alias("_P"), *[F.coalesce(F.sum(f"_cum_{c}").over(before), F.lit(0)).alias(f"_off_{c}") for c in ("pos", "n")])
    term = F.col("_pos") / F.col("_P") * (F.col("_off_pos") + F.col("_cum_pos")) / (F.col("_off_n") + F.col("_cum_n"))
    ap = ranged.join(F.broadcast(totals), ["_k", "_pid"]).groupBy("_k").agg(F.sum(F.when(F.col("_P") > 0, term)).alias("average_precision"))
    return ap.select(F.col("_k").cast(df.schema[key].dataType).alias(key), "average_precision")


def with_avg_rank_pct(df: DataFrame, value: str, out: str, *, keys: list[str] = ()) -> DataFrame:
    """pandas ``rank(pct=True)`` (average method) of ``value`` within ``keys``.

    pct = (rows below + (ties + 1) / 2) / non-null rows in the group; NULL value -> NULL.
    """
    keys = list(keys)
    r = value_counts_ranked(df, value, keys=keys)
    r = r.select(*keys, value,
                 ((F.col("_cum__n") - F.col("_n") + (F.col("_n") + 1) / 2.0) / F.col("_grp_n")).alias(out))
    return df.join(r, [*keys, value], "left")


def exact_quantiles(df: DataFrame, value: str, quantiles: dict[str, float], *, keys: list[str] = ()) -> DataFrame:
    """Exact linear-interpolated quantiles (pandas / DuckDB ``quantile_cont``) per key group.

    Works on value counts and running counts, once for all quantiles, so no group is ever
    collected into one task. Returns ``keys`` and one column for each name in ``quantiles``.
    """
    keys = list(keys)
    r = value_counts_ranked(df, value, keys=keys)
    first_pos = F.col("_cum__n") - F.col("_n")  # 0-based position of the first copy
    last_pos = F.col("_cum__n") - 1
    at = {name: (F.col("_grp_n") - 1) * F.lit(float(q)) for name, q in quantiles.items()}
    covers = lambda p: (first_pos <= p) & (p <= last_pos)
    picked = [x for name, h in at.items() for x in (F.max(F.when(covers(F.floor(h)), F.col(value))).alias(f"_lo_{name}"),
                                                    F.max(F.when(covers(F.ceil(h)), F.col(value))).alias(f"_hi_{name}"))]
    agg = r.groupBy(*keys).agg(F.first("_grp_n").alias("_grp_n"), *picked)
    part = lambda name: at[name] - F.floor(at[name])
    return agg.select(*keys, *[(F.col(f"_lo_{x}") + (F.col(f"_hi_{x}") - F.col(f"_lo_{x}")) * part(x)).alias(x) for x in quantiles])


def exact_quantile(df: DataFrame, value: str, q: float, *, keys: list[str] = ()) -> DataFrame:
    """One exact quantile: ``keys + [q_<value>]`` (one row, or one row per group)."""
    return exact_quantiles(df, value, {f"q_{value}": q}, keys=keys)


def row_number_within(df: DataFrame, keys: list[str], order: list, out: str = "_rn") -> DataFrame:
    """1-based row number inside ``keys`` groups in ``order`` (a total order), skew-safe.

    Same result as ``row_number() over (partition by keys order by order)`` but a hot group is
    spread over several range partitions instead of one task. Rows are shuffled once: the place
    within a sorted range comes from the low 33 bits of ``monotonically_increasing_id``, the
    rows before it from the ranges' counts. With ``keys``, ``{out}_n`` is the group's size; null
    keys are a group.
    """
    keys = list(keys)
    ensure_checkpoint_dir(df.sparkSession)
    place = [*[F.col(k) for k in keys], *order]
    ranged = (df.repartitionByRange(default_parts(df), *place).sortWithinPartitions(*place)
                .withColumn("_m", F.monotonically_increasing_id()).checkpoint(eager=True))
    ranged = ranged.withColumn("_pid", F.shiftright("_m", 33)).withColumn("_at", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_m")
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"))  # one row for each range
                     .select("_pid", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off")))
    ranked = ranged.join(F.broadcast(offsets), "_pid").withColumn(out, F.col("_off") + F.col("_at")).drop("_pid", "_off", "_at")
    if not keys:
        return ranked
    start = ranked.groupBy(*keys).agg((F.min(out) - 1).alias("_start"), F.count(F.lit(1)).alias(f"{out}_n"))
    start = start.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_start", f"{out}_n")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return ranked.join(start, same).withColumn(out, F.col(out) - F.col("_start")).drop("_start", *[f"_k{i}" for i in range(len(keys))])
