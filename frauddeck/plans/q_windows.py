"""Registered queries: per-entity history windows.

Spark side: the skew-safe bucketed implementation in :mod:`frauddeck.operators.windows`.
Oracle side: the textbook single-window SQL, so each query also checks that the
bucket decomposition is exact.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from frauddeck.operators import globalrank, windows as W
from frauddeck.plans.catalog import query
from frauddeck.plans.common import joined, ltx, r, tx, views
from frauddeck.sources import adapter
from frauddeck.sources.io import written
from frauddeck.operators.attach import attach_row

MEDIAN_SQL = "(SELECT quantile_cont(TX_AMOUNT, 0.5) FROM {t})"


def _median(df, col="TX_AMOUNT"):
    return globalrank.exact_quantile(df, col, 0.5).select(F.col(f"q_{col}").alias("_median"))


@query("e1_time_since_last_customer", """
SELECT TX_ID, ROUND(COALESCE((epoch_us(TX_TS) - lag(epoch_us(TX_TS)) OVER (PARTITION BY CUSTOMER_ID ORDER BY TX_TS, TX_ID))
  / 1e6, 86400), 6) AS time_since_last_tx FROM tx""")
def e1_time_since_last_customer(spark, sf):
    d = W.add_time_since_last(tx(spark, sf), ["CUSTOMER_ID"], "time_since_last_tx", 86400)
    return d.select("TX_ID", r("time_since_last_tx").alias("time_since_last_tx"))


@query("e1_time_since_last_terminal_ties", """
SELECT TX_ID, ROUND(COALESCE((epoch_us(TX_TS) - lag(epoch_us(TX_TS)) OVER (PARTITION BY TERMINAL_ID ORDER BY TX_TS, TX_ID))
  / 1e6, 1e9), 6) AS time_since_last_TERMINAL_ID_sec FROM ltx""")
def e1_time_since_last_terminal_ties(spark, sf):
    d = W.add_time_since_last(ltx(spark, sf), ["TERMINAL_ID"], "time_since_last_TERMINAL_ID_sec", 1e9)
    return d.select("TX_ID", r("time_since_last_TERMINAL_ID_sec").alias("time_since_last_TERMINAL_ID_sec"))


@query("e2_time_since_last_pair", """
SELECT TX_ID, ROUND(COALESCE((epoch_us(TX_TS) - lag(epoch_us(TX_TS)) OVER (PARTITION BY CUSTOMER_ID, MERCHANT_ID
  ORDER BY TX_TS, TX_ID)) / 1e6, 2592000), 6) AS time_since_last_tx_merchant FROM ltx""")
def e2_time_since_last_pair(spark, sf):
    d = W.add_time_since_last(ltx(spark, sf), ["CUSTOMER_ID", "MERCHANT_ID"], "time_since_last_tx_merchant", 86400 * 30)
    return d.select("TX_ID", r("time_since_last_tx_merchant").alias("time_since_last_tx_merchant"))


@query("e3_unix_second_gaps", """
SELECT TX_ID, epoch_us(TX_TS) // 1000000 AS TX_TS_unix,
  COALESCE(CAST(epoch_us(TX_TS) // 1000000 - lag(epoch_us(TX_TS) // 1000000) OVER (PARTITION BY CUSTOMER_ID ORDER BY TX_TS, TX_ID) AS DOUBLE), 0) AS cust_prev_tx_time,
  COALESCE(CAST(epoch_us(TX_TS) // 1000000 - lag(epoch_us(TX_TS) // 1000000) OVER (PARTITION BY TERMINAL_ID ORDER BY TX_TS, TX_ID) AS DOUBLE), 0) AS term_prev_tx_time
FROM tx""")
def e3_unix_second_gaps(spark, sf):
    d = W.add_time_since_last(tx(spark, sf), ["CUSTOMER_ID"], "cust_prev_tx_time", 0, whole_seconds=True)
    d = W.add_time_since_last(d, ["TERMINAL_ID"], "term_prev_tx_time", 0, whole_seconds=True)
    return d.select("TX_ID", F.unix_seconds("TX_TS").alias("TX_TS_unix"), "cust_prev_tx_time", "term_prev_tx_time")


@query("e4_running_counts", """
SELECT TX_ID, row_number() OVER (PARTITION BY CUSTOMER_ID ORDER BY TX_TS, TX_ID) AS cust_tx_count_cumm,
  row_number() OVER (PARTITION BY CUSTOMER_ID, MERCHANT_ID ORDER BY TX_TS, TX_ID) - 1 AS cust_merchant_pair_count_cumm
FROM ltx""")
def e4_running_counts(spark, sf):
    d = W.add_running_count(ltx(spark, sf), ["CUSTOMER_ID"], "cust_tx_count_cumm")
    d = W.add_running_count(d, ["CUSTOMER_ID", "MERCHANT_ID"], "cust_merchant_pair_count_cumm", zero_based=True)
    return d.select("TX_ID", "cust_tx_count_cumm", "cust_merchant_pair_count_cumm")


def _e5_sql(t: str) -> str:
    return f"""
WITH m AS (SELECT quantile_cont(TX_AMOUNT, 0.5) AS med FROM {t}),
h AS (SELECT TX_ID, TX_AMOUNT,
  avg(TX_AMOUNT) OVER w AS pm, stddev_samp(TX_AMOUNT) OVER w AS ps, max(TX_AMOUNT) OVER w AS px
  FROM {t} WINDOW w AS (PARTITION BY CUSTOMER_ID ORDER BY TX_TS, TX_ID ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT TX_ID, ROUND(COALESCE(pm, med), 6) AS cust_avg_amount_cumm, ROUND(COALESCE(ps, 0), 4) AS cust_std_amount_cumm,
  ROUND(COALESCE(px, med), 6) AS cust_max_amount_cumm,
  ROUND(COALESCE((TX_AMOUNT - COALESCE(pm, med)) / (CASE WHEN COALESCE(ps, 0) = 0 THEN 1 ELSE COALESCE(ps, 0) END), 0), 4) + 0.0
    AS amount_deviation,
  ROUND(TX_AMOUNT / (CASE WHEN COALESCE(px, med) = 0 THEN 1 ELSE COALESCE(px, med) END), 6) AS amount_to_max_ratio,
  CAST(TX_AMOUNT > COALESCE(pm, med) * 3 AS INTEGER) AS is_high_amount
FROM h, m"""


def _e5(df):
    h = W.prior_history(df, ["CUSTOMER_ID"])
    h = attach_row(h, _median(df))
    med = F.col("_median")
    pm = F.coalesce(W.prior_mean(), med)
    ps = F.coalesce(W.prior_std(), F.lit(0.0))
    px = F.coalesce(F.col("_hmax"), med)
    amt = F.col("TX_AMOUNT")
    return h.select(
        "TX_ID", r(pm).alias("cust_avg_amount_cumm"), r(ps, 4).alias("cust_std_amount_cumm"),
        r(px).alias("cust_max_amount_cumm"),
        r(F.coalesce((amt - pm) / F.when(ps == 0, 1.0).otherwise(ps), F.lit(0.0)), 4).alias("amount_deviation"),
        r(amt / F.when(px == 0, 1.0).otherwise(px)).alias("amount_to_max_ratio"),
        (amt > pm * 3).cast("int").alias("is_high_amount"))


@query("e5_e17_prior_expanding_stats", _e5_sql("tx"))
def e5_e17_prior_expanding_stats(spark, sf):
    return _e5(tx(spark, sf))


@query("e5_e17_prior_expanding_stats_ties", _e5_sql("ltx"))
def e5_e17_prior_expanding_stats_ties(spark, sf):
    return _e5(ltx(spark, sf))


def _lastn_sql(t: str, key: str = "CUSTOMER_ID") -> str:
    sel = []
    wins = []
    for n in (3, 5, 10):
        wins.append(f"w{n} AS (PARTITION BY {key} ORDER BY TX_TS, TX_ID ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)")
        sel.append(f"""ROUND(COALESCE(CASE WHEN count(TX_AMOUNT) OVER w{n} = {n} THEN avg(TX_AMOUNT) OVER w{n} END, med), 6)
                   AS cust_amount_mean_last_{n}""")
        sel.append(f"""ROUND(COALESCE(CASE WHEN count(TX_AMOUNT) OVER w{n} = {n} THEN stddev_samp(TX_AMOUNT) OVER w{n} END, 0), 4)
                   AS cust_amount_std_last_{n}""")
        sel.append(f"""CASE WHEN rn < {n} THEN 0 ELSE LEAST(rn - 1, {n}) END AS cust_tx_count_last_{n}""")
        sel.append(f"""ROUND(COALESCE(avg(TX_AMOUNT) OVER w{n}, med), 6) AS amount_mean_last_{n}""")
        sel.append(f"""LEAST(rn - 1, {n}) AS tx_count_last_{n}""")
    return f"""
SELECT TX_ID, {", ".join(sel)}
FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY TX_TS, TX_ID) AS rn FROM {t}),
     (SELECT quantile_cont(TX_AMOUNT, 0.5) AS med FROM {t})
WINDOW {", ".join(wins)}"""


def _lastn(df):
    h = attach_row(W.prior_history(df, ["CUSTOMER_ID"], last_n=[3, 5, 10]), _median(df))
    med, rn = F.col("_median"), F.col("_hrn")
    cols = []
    for n in (3, 5, 10):
        full = F.col(f"_hl{n}_cnt") == n
        cols += [
            r(F.coalesce(F.when(full, W.lastn_mean(n)), med)).alias(f"cust_amount_mean_last_{n}"),
            r(F.coalesce(F.when(full, W.lastn_std(n)), F.lit(0.0)), 4).alias(f"cust_amount_std_last_{n}"),
            F.when(rn < n, F.lit(0)).otherwise(F.least(rn - 1, F.lit(n))).cast("bigint").alias(f"cust_tx_count_last_{n}"),
            r(F.coalesce(W.lastn_mean(n), med)).alias(f"amount_mean_last_{n}"),
            F.least(rn - 1, F.lit(n)).cast("bigint").alias(f"tx_count_last_{n}"),
        ]
    return h.select("TX_ID", *cols)


@query("e6_e7_last_n_prior", _lastn_sql("tx"))
def e6_e7_last_n_prior(spark, sf):
    return _lastn(tx(spark, sf))


@query("e6_e7_last_n_prior_ties", _lastn_sql("ltx"))
def e6_e7_last_n_prior_ties(spark, sf):
    return _lastn(ltx(spark, sf))


def _incl_sql(t: str) -> str:
    sel, wins = [], []
    for n in (3, 5, 10):
        wins.append(f"c{n} AS (PARTITION BY CUSTOMER_ID ORDER BY TX_TS, TX_ID ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)")
        wins.append(f"t{n} AS (PARTITION BY TERMINAL_ID ORDER BY TX_TS, TX_ID ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)")
        sel += [f"ROUND(sum(TX_AMOUNT) OVER c{n}, 4) AS cust_last{n}_tx_sum",
                f"ROUND(avg(TX_AMOUNT) OVER c{n}, 6) AS cust_last{n}_tx_mean",
                f"ROUND(sum(TX_AMOUNT) OVER t{n}, 4) AS term_last{n}_tx_sum"]
    sel += ["ROUND(avg(TX_AMOUNT) OVER c10, 6) AS cust_amount_rolling_mean",
            "ROUND(abs(TX_AMOUNT - avg(TX_AMOUNT) OVER c10) / (avg(TX_AMOUNT) OVER c10 + 1e-8), 6) AS cust_amount_deviation_rolling",
            "LEAST(row_number() OVER (PARTITION BY CUSTOMER_ID ORDER BY TX_TS, TX_ID), 10) - 1 AS cust_tx_velocity_1h",
            "LEAST(row_number() OVER (PARTITION BY CUSTOMER_ID ORDER BY TX_TS, TX_ID), 50) - 1 AS cust_tx_velocity_24h",
            "LEAST(row_number() OVER (PARTITION BY TERMINAL_ID ORDER BY TX_TS, TX_ID), 10) - 1 AS term_tx_velocity_1h"]
    return f"SELECT TX_ID, {', '.join(sel)} FROM {t} WINDOW {', '.join(wins)}"


ROWS_PER_TASK = 500_000  # of narrow rows: a task's sort takes some 100 MB


def _incl(df):
    """The terminal's figures first: fewer of them travel with the rows to the customer's window."""
    amt, rows = F.col("TX_AMOUNT"), df.select("TX_ID", "TX_TS", "CUSTOMER_ID", "TERMINAL_ID", "TX_AMOUNT")
    t = W.prior_history(rows, ["TERMINAL_ID"], last_n=[2, 4, 9], p="_t", rows_per_task=ROWS_PER_TASK)
    sums = {f"term_last{n}_tx_sum": F.coalesce(F.col(f"_tl{n - 1}_sum"), F.lit(0.0)) + amt for n in (3, 5, 10)}
    t = t.select("TX_ID", "TX_TS", "CUSTOMER_ID", "TX_AMOUNT", *[r(c, 4).alias(x) for x, c in sums.items()],
                 (F.least(F.col("_trn"), F.lit(10)) - 1).alias("term_tx_velocity_1h"))
    c = W.prior_history(t, ["CUSTOMER_ID"], last_n=[2, 4, 9], p="_c", rows_per_task=ROWS_PER_TASK, keys_of=rows)
    cols = []
    for n in (3, 5, 10):
        csum = F.coalesce(F.col(f"_cl{n - 1}_sum"), F.lit(0.0)) + amt
        ccnt = F.col(f"_cl{n - 1}_cnt") + 1
        cols += [r(csum, 4).alias(f"cust_last{n}_tx_sum"), r(csum / ccnt).alias(f"cust_last{n}_tx_mean"), F.col(f"term_last{n}_tx_sum")]
    m10 = (F.coalesce(F.col("_cl9_sum"), F.lit(0.0)) + amt) / (F.col("_cl9_cnt") + 1)
    cols += [r(m10).alias("cust_amount_rolling_mean"),
             r(F.abs(amt - m10) / (m10 + 1e-8)).alias("cust_amount_deviation_rolling"),
             (F.least(F.col("_crn"), F.lit(10)) - 1).alias("cust_tx_velocity_1h"),
             (F.least(F.col("_crn"), F.lit(50)) - 1).alias("cust_tx_velocity_24h"), F.col("term_tx_velocity_1h")]
    return c.select("TX_ID", *cols)


@query("e8_e9_e10_inclusive_rolling", _incl_sql("tx"))
def e8_e9_e10_inclusive_rolling(spark, sf):
    return _incl(tx(spark, sf))


@query("e8_e9_e10_inclusive_rolling_ties", _incl_sql("ltx"))
def e8_e9_e10_inclusive_rolling_ties(spark, sf):
    return _incl(ltx(spark, sf))


def _twin_sql(t: str) -> str:
    parts = []
    for key in ("CUSTOMER_ID", "TERMINAL_ID"):
        for label, secs in (("24h", 86400), ("7d", 604800)):
            parts.append(f"""(SELECT count(*) FROM {t} b WHERE b.{key} = a.{key}
               AND epoch_us(b.TX_TS) > epoch_us(a.TX_TS) - {secs}000000
               AND (b.TX_TS < a.TX_TS OR (b.TX_TS = a.TX_TS AND b.TX_ID < a.TX_ID))) AS count_{label}_{key}""")
    return f"SELECT TX_ID, {', '.join(parts)} FROM {t} a"


def _twin(df):
    d = written(df.select("TX_ID", "TX_TS", "CUSTOMER_ID", "TERMINAL_ID"))  # counted and read several times
    n, unique = d.count(), W.ids_unique(d)
    d = W.add_time_window_counts(d, "CUSTOMER_ID", n_rows=n, unique=unique)
    d = W.add_time_window_counts(d, "TERMINAL_ID", n_rows=n if unique else None, unique=unique)
    return d.select("TX_ID", "count_24h_CUSTOMER_ID", "count_7d_CUSTOMER_ID", "count_24h_TERMINAL_ID",
                    "count_7d_TERMINAL_ID")


@query("e11_trailing_time_counts", _twin_sql("tx"))
def e11_trailing_time_counts(spark, sf):
    return _twin(tx(spark, sf))


@query("e11_trailing_time_counts_ties", _twin_sql("ltx"))
def e11_trailing_time_counts_ties(spark, sf):
    return _twin(ltx(spark, sf))


def _z_sql(t: str) -> str:
    sel = []
    for key in ("CUSTOMER_ID", "TERMINAL_ID", "MERCHANT_ID"):
        w = f"(PARTITION BY {key} ORDER BY TX_TS, TX_ID ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        sel += [f"ROUND(avg(TX_AMOUNT) OVER {w}, 6) AS mean_amt_{key}",
                f"ROUND(COALESCE(stddev_samp(TX_AMOUNT) OVER {w}, 0), 4) AS std_amt_{key}",
                f"""ROUND((TX_AMOUNT - COALESCE(avg(TX_AMOUNT) OVER {w}, 0)) /
                    (COALESCE(stddev_samp(TX_AMOUNT) OVER {w}, 0) + 1e-6), 2) + 0.0 AS z_amt_{key}"""]
    return f"SELECT TX_ID, {', '.join(sel)} FROM {t}"


def _z(df):
    d = df
    for i, key in enumerate(("CUSTOMER_ID", "TERMINAL_ID", "MERCHANT_ID")):
        p = f"_z{i}"
        d = W.prior_history(d, [key], p=p)
        m, s = W.prior_mean(p), F.coalesce(W.prior_std(p), F.lit(0.0))
        d = W.drop_helpers(d.withColumns({
            f"mean_amt_{key}": m, f"std_amt_{key}": s,
            f"z_amt_{key}": (F.col("TX_AMOUNT") - F.coalesce(m, F.lit(0.0))) / (s + 1e-6)}), p)
    out = ["TX_ID"]
    for key in ("CUSTOMER_ID", "TERMINAL_ID", "MERCHANT_ID"):
        out += [r(f"mean_amt_{key}").alias(f"mean_amt_{key}"), r(f"std_amt_{key}", 4).alias(f"std_amt_{key}"),
                r(f"z_amt_{key}", 2).alias(f"z_amt_{key}")]
    return d.select(*out)


@query("e12_prior_zscores", _z_sql("tx"))
def e12_prior_zscores(spark, sf):
    return _z(tx(spark, sf))


@query("e13_prev_terminal_hop", """
WITH j AS (SELECT t.*, x_terminal_id, y_terminal_id FROM ltx t LEFT JOIN terminals USING (TERMINAL_ID)),
h AS (SELECT TX_ID,
  sqrt(pow(x_terminal_id - lag(x_terminal_id) OVER w, 2) + pow(y_terminal_id - lag(y_terminal_id) OVER w, 2)) AS d,
  COALESCE((epoch_us(TX_TS) - lag(epoch_us(TX_TS)) OVER w) / 1e6, 1e9) AS gap
  FROM j WINDOW w AS (PARTITION BY CUSTOMER_ID ORDER BY TX_TS, TX_ID))
SELECT TX_ID, ROUND(COALESCE(d, 0), 6) AS dist_prev_terminal,
  ROUND(COALESCE(d, 0) / GREATEST(gap, 1), 9) AS velocity_customer FROM h""")
def e13_prev_terminal_hop(spark, sf):
    v = views(spark, sf, "lineitem")
    j = v["transactions"].join(v["terminals"], "TERMINAL_ID", "left")
    d = W.add_prev_location(j, "CUSTOMER_ID", "x_terminal_id", "y_terminal_id", first_gap=1e9)
    return d.select("TX_ID", r("dist_prev_terminal").alias("dist_prev_terminal"),
                    r("velocity_customer", 9).alias("velocity_customer"))


@query("e14_amount_pct_in_merchant", """
SELECT TX_ID, ROUND((rank() OVER (PARTITION BY MERCHANT_ID ORDER BY TX_AMOUNT)
  + (count(*) OVER (PARTITION BY MERCHANT_ID, TX_AMOUNT) - 1) / 2.0)
  / count(TX_AMOUNT) OVER (PARTITION BY MERCHANT_ID), 6) AS amount_percentile_merchant FROM ltx""")
def e14_amount_pct_in_merchant(spark, sf):
    d = W.add_rank_pct(ltx(spark, sf), "TX_AMOUNT", "amount_percentile_merchant", keys=["MERCHANT_ID"])
    return d.select("TX_ID", r("amount_percentile_merchant").alias("amount_percentile_merchant"))


@query("e15_global_pct_rank", """
SELECT TX_ID, ROUND((rank() OVER (ORDER BY TX_FRAUD) + (count(*) OVER (PARTITION BY TX_FRAUD) - 1) / 2.0)
  / count(*) OVER (), 6) AS score_rank FROM scores_a""")
def e15_global_pct_rank(spark, sf):
    s = adapter.scores_a(tx(spark, sf))
    d = W.add_rank_pct(s, "TX_FRAUD", "score_rank")
    return d.select("TX_ID", r("score_rank").alias("score_rank"))


@query("e16_amount_over_customer_mean", """
SELECT TX_ID, ROUND(TX_AMOUNT / avg(TX_AMOUNT) OVER (PARTITION BY CUSTOMER_ID), 6) AS amount_to_customer_mean FROM ltx""")
def e16_amount_over_customer_mean(spark, sf):
    d = W.add_entity_stats(ltx(spark, sf), "CUSTOMER_ID", "TX_AMOUNT", {"_cm": "mean"})
    return d.select("TX_ID", r(F.col("TX_AMOUNT") / F.col("_cm")).alias("amount_to_customer_mean"))


@query("e18_activity_intensity", """
SELECT TX_ID, ROUND(row_number() OVER w / (COALESCE((epoch_us(TX_TS) - lag(epoch_us(TX_TS)) OVER w) / 1e6, 86400) / 3600 + 1), 6)
  AS activity_intensity FROM tx WINDOW w AS (PARTITION BY CUSTOMER_ID ORDER BY TX_TS, TX_ID)""")
def e18_activity_intensity(spark, sf):
    h = W.prior_history(tx(spark, sf), ["CUSTOMER_ID"], value=None)
    gap = F.coalesce(W.seconds_since_prev(), F.lit(86400.0))
    return h.select("TX_ID", r(F.col("_hrn") / (gap / 3600 + 1)).alias("activity_intensity"))


_ = (joined,)


HOT_SQL = "(SELECT * REPLACE (CASE WHEN TX_ID % 3 = 0 THEN 0 ELSE CUSTOMER_ID END AS CUSTOMER_ID) FROM tx)"


def _hot(spark, sf):
    """Events with one hot customer (id 0) that owns a third of all rows."""
    t = tx(spark, sf)
    return t.withColumn("CUSTOMER_ID", F.when(F.col("TX_ID") % 3 == 0, F.lit(0).cast("bigint"))
                        .otherwise(F.col("CUSTOMER_ID")))


@query("e5_e6_hot_customer_skew", f"""
WITH h AS {HOT_SQL}
SELECT TX_ID, row_number() OVER w AS rn, ROUND(avg(TX_AMOUNT) OVER wp, 6) AS prior_mean,
  ROUND(COALESCE(stddev_samp(TX_AMOUNT) OVER wp, 0), 4) AS prior_std, max(TX_AMOUNT) OVER wp AS prior_max,
  ROUND(avg(TX_AMOUNT) OVER w5, 6) AS mean_last_5,
  ROUND((epoch_us(TX_TS) - lag(epoch_us(TX_TS)) OVER w) / 1e6, 6) AS gap_s
FROM h WINDOW w AS (PARTITION BY CUSTOMER_ID ORDER BY TX_TS, TX_ID),
  wp AS (PARTITION BY CUSTOMER_ID ORDER BY TX_TS, TX_ID ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  w5 AS (PARTITION BY CUSTOMER_ID ORDER BY TX_TS, TX_ID ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""")
def e5_e6_hot_customer_skew(spark, sf):
    """Skew stress: the hot key is split into daily buckets instead of one task."""
    # a small bucket size so the hot key is split even at the small test scales
    h = W.prior_history(_hot(spark, sf), ["CUSTOMER_ID"], last_n=[5], rows_per_bucket=200)
    return h.select("TX_ID", F.col("_hrn").alias("rn"), r(W.prior_mean()).alias("prior_mean"),
                    r(F.coalesce(W.prior_std(), F.lit(0.0)), 4).alias("prior_std"), F.col("_hmax").alias("prior_max"),
                    r(W.lastn_mean(5)).alias("mean_last_5"), r(W.seconds_since_prev()).alias("gap_s"))


@query("e11_hot_customer_time_counts", f"""
WITH h AS {HOT_SQL}
SELECT a.TX_ID, (SELECT count(*) FROM h b WHERE b.CUSTOMER_ID = a.CUSTOMER_ID
   AND epoch_us(b.TX_TS) > epoch_us(a.TX_TS) - 86400000000
   AND (b.TX_TS < a.TX_TS OR (b.TX_TS = a.TX_TS AND b.TX_ID < a.TX_ID))) AS count_24h_CUSTOMER_ID FROM h a""")
def e11_hot_customer_time_counts(spark, sf):
    d = W.add_time_window_counts(_hot(spark, sf), "CUSTOMER_ID", {"24h": 86400})
    return d.select("TX_ID", "count_24h_CUSTOMER_ID")
