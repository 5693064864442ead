"""History windows: hand-made cases (FIXTURES 4) and a plain loop with a hot key, null keys and a burst."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from frauddeck.operators import windows as W

SCHEMA = "TX_ID bigint, TX_TS timestamp, CUSTOMER_ID string, TX_AMOUNT double"


def _ts(s):
    return dt.datetime.fromisoformat(s)


@pytest.fixture
def six(spark):
    rows = [(1, _ts("2024-01-01 00:00"), "A", 10.0), (2, _ts("2024-01-01 10:00"), "A", 20.0),
            (3, _ts("2024-01-01 10:00"), "A", 0.0), (4, _ts("2024-01-02 00:00"), "A", 30.0),
            (5, _ts("2024-01-02 10:00"), "A", 40.0), (6, _ts("2024-01-06 11:00"), "A", 50.0),
            (7, _ts("2024-01-03 00:00"), "B", 5.0)]
    return spark.createDataFrame(rows, SCHEMA)


def test_24h_counts_tie_exact(six):
    out = W.add_time_window_counts(six, "CUSTOMER_ID", {"24h": 86400})
    got = dict(out.select("TX_ID", "count_24h_CUSTOMER_ID").collect())
    assert [got[i] for i in range(1, 7)] == [0, 1, 2, 2, 1, 0]
    assert got[7] == 0  # single-row entity


def test_prior_history_first_row_and_single_row(six):
    h = W.prior_history(six, ["CUSTOMER_ID"], last_n=[3], rows_per_bucket=2)
    r = {x["TX_ID"]: x for x in h.select("TX_ID", "_hrn", "_hcnt", "_hsum", "_hmax", "_hl3_cnt",
                                        W.prior_std().alias("std")).collect()}
    assert r[1]["_hrn"] == 1 and r[1]["_hcnt"] == 0 and r[1]["_hsum"] is None and r[1]["_hmax"] is None
    assert r[7]["_hrn"] == 1 and r[7]["std"] is None  # std of <2 values is NULL (ddof=1)
    assert r[2]["std"] is None and r[3]["_hcnt"] == 2
    assert r[6]["_hrn"] == 6 and r[6]["_hl3_cnt"] == 3 and r[6]["_hsum"] == 100.0


def test_constant_values_std_exactly_zero(spark):
    rows = [(i, _ts("2024-01-01 00:00") + dt.timedelta(hours=7 * i), "C", 0.1) for i in range(20)]
    h = W.prior_history(spark.createDataFrame(rows, SCHEMA), ["CUSTOMER_ID"], last_n=[5], rows_per_bucket=3)
    stds = [x[0] for x in h.select(W.prior_std()).collect() if x[0] is not None]
    assert stds and all(s == 0.0 for s in stds)


def _plain(rows):
    """The same history by a loop over each customer's sorted rows; null customers have none."""
    by = {}
    for tx, ts, cust, amt in rows:
        by.setdefault(("solo", tx) if cust is None else cust, []).append((ts, tx, amt))
    out = {}
    for own in by.values():
        own.sort(key=lambda r: (r[0], r[1]))
        for i, (ts, tx, _) in enumerate(own):
            before = [a for _, _, a in own[:i] if a is not None]
            last3 = [a for _, _, a in own[max(i - 3, 0):i] if a is not None]
            out[tx] = {"rn": i + 1, "pmean": statistics.fmean(before) if before else None, "pstd": statistics.stdev(before) if len(before) > 1 else None,
                       "pmax": max(before, default=None), "l3": statistics.fmean(last3) if last3 else None,
                       "l3std": statistics.stdev(last3) if len(last3) > 1 else None, "prev": (ts - own[i - 1][0]).total_seconds() if i else None}
    return out


def _history(df, **kw):
    h = W.prior_history(df, ["CUSTOMER_ID"], last_n=[3], **kw)
    cols = {"rn": F.col("_hrn"), "pmean": W.prior_mean(), "pstd": W.prior_std(), "pmax": F.col("_hmax"), "l3": W.lastn_mean(3), "l3std": W.lastn_std(3), "prev": W.seconds_since_prev()}
    return {r["TX_ID"]: r.asDict() for r in h.select("TX_ID", *[c.alias(k) for k, c in cols.items()]).collect()}


def _same(got, want, rel=1e-9):
    assert set(got) == set(want)
    for tx, w in want.items():
        for k, v in w.items():
            assert got[tx][k] == (None if v is None else pytest.approx(v, rel=rel, abs=1e-9)), (tx, k)


def _random_rows(offset=0.0):
    rnd = random.Random(7)
    rows, start = [], _ts("2024-01-01 00:00")
    for i in range(900):
        cust = None if i % 50 == 0 else "HOT" if i % 3 else f"c{rnd.randint(0, 30)}"  # one key holds two thirds of the rows
        ts = start + dt.timedelta(hours=rnd.randint(0, 24 * 40))  # hourly ties across 40 daily buckets
        rows.append((i, ts, cust, None if rnd.random() < 0.05 else offset + round(rnd.uniform(0, 500), 2)))
    # a burst: one row long before all others
    rows.append((5000, _ts("1999-01-01 00:00"), "HOT", offset + 1.0))
    return rows


@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 40])
def test_history_matches_a_plain_loop_on_both_sides_of_the_threshold(spark, rows_per_bucket):
    rows = _random_rows()
    _same(_history(spark.createDataFrame(rows, SCHEMA), rows_per_bucket=rows_per_bucket), _plain(rows))


@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 40])
def test_std_of_large_values_keeps_its_digits(spark, rows_per_bucket):
    rows = [(i, _ts("2024-01-01 00:00") + dt.timedelta(hours=i), "A", 1e9 + 1 + 2 * i) for i in range(3)]
    got = _history(spark.createDataFrame(rows + [(3, _ts("2024-02-01 00:00"), "A", 0.0)], SCHEMA), rows_per_bucket=rows_per_bucket)
    assert got[2]["pstd"] == pytest.approx(2 ** 0.5) and got[3]["pstd"] == pytest.approx(2.0) and got[3]["l3std"] == pytest.approx(2.0)
    big = _random_rows(1e9)
    _same(_history(spark.createDataFrame(big, SCHEMA), rows_per_bucket=rows_per_bucket), _plain(big), rel=1e-6)


def test_rows_with_a_null_key_stay(spark):
    rows = [(i, _ts("2024-01-01 00:00") + dt.timedelta(hours=i), None if i % 2 else "A", 1.0) for i in range(8)]
    out = W.add_time_since_last(spark.createDataFrame(rows, SCHEMA), ["CUSTOMER_ID"], "gap", -1.0)
    got = dict(out.select("TX_ID", "gap").collect())
    assert len(got) == 8 and all(got[i] == -1.0 for i in (1, 3, 5, 7)) and got[2] == 7200.0


def _burst(one_second=700, others=1300):
    """A third of all rows lie in one second of one key; the others in ties over other keys and days."""
    rnd = random.Random(11)
    start = _ts("2024-01-01 00:00")
    rows = [(i, start + dt.timedelta(hours=100), "HOT", 1.0 + i % 7) for i in range(one_second)]
    rows += [(one_second + i, start + dt.timedelta(hours=rnd.randint(0, 400)), rnd.choice(["HOT", "a", "b", None]), rnd.uniform(0, 9)) for i in range(others)]
    rnd.shuffle(rows)
    return rows


def test_hot_key_is_split_by_its_own_rows(spark):
    df = spark.createDataFrame(_burst(), SCHEMA).withColumn("_us", F.unix_micros("TX_TS"))
    assert W._hot_keys(df, ["CUSTOMER_ID"], 5000)[0] is None
    hot, thr = W._hot_keys(df, ["CUSTOMER_ID"], 500)
    assert [r[0] for r in hot.select("CUSTOMER_ID").collect()] == ["HOT"] and thr == 500
    cut = W._with_buckets(df.filter("CUSTOMER_ID is not null"), ["CUSTOMER_ID"], hot, thr, "TX_ID")
    assert cut.groupBy("CUSTOMER_ID", "_b").count().agg(F.max("count")).first()[0] <= 500  # even the rows of one second


@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 60])
def test_a_burst_in_one_second(spark, rows_per_bucket):
    rows = _burst(120, 240)
    df = spark.createDataFrame(rows, SCHEMA)
    _same(_history(df, rows_per_bucket=rows_per_bucket), _plain(rows))
    windows = {"24h": 86400, "7d": 7 * 86400}
    out = W.add_time_window_counts(df, "CUSTOMER_ID", windows, rows_per_bucket=rows_per_bucket)
    got = {r["TX_ID"]: (r["count_24h_CUSTOMER_ID"], r["count_7d_CUSTOMER_ID"]) for r in out.collect()}
    for tx, ts, cust, _ in rows:
        before = [t for x, t, c, _ in rows if c == cust and cust is not None and (t, x) < (ts, tx)]
        assert got[tx] == tuple(sum((ts - t).total_seconds() < w for t in before) for w in windows.values()), tx


def test_burst_counts_spread_over_ranges(spark):
    """Counts by ranks: rows of one second of one key lie in several ranges, none with more than its share."""
    from frauddeck.operators import globalrank
    seen = []
    real = globalrank.prefix_sums
    df = spark.createDataFrame(_burst(), SCHEMA)
    try:
        globalrank.prefix_sums = lambda d, order, sums, **k: seen.append((d, order)) or real(d, order, sums, **k)
        W.add_time_window_counts(df, "CUSTOMER_ID", rows_per_bucket=400).count()
    finally:
        globalrank.prefix_sums = real
    (d, order), = seen
    sizes = [r["count"] for r in d.repartitionByRange(8, *order).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * sum(sizes) / 8


def test_ordinary_keys_cost_one_exchange(spark, six):
    plan = W.prior_history(six, ["CUSTOMER_ID"], last_n=[3, 10], lags=["TX_AMOUNT"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_history_window_is_partitioned(spark, six):
    """Plan check: every Window in the history operator has a partition key (no single task)."""
    h = W.prior_history(six, ["CUSTOMER_ID"], last_n=[3])
    plan = h._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "Window [" in line:
            assert "CUSTOMER_ID" in line, line
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan
