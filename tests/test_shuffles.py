"""What a plan shuffles, how many jobs a fit takes and how much memory a task's sums take."""

import datetime as dt
import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from frauddeck.operators import curves, globalrank, leafwise as L, ml, network as N, windows as W
from frauddeck.plans import pipelines as P
from frauddeck.sources import adapter


def _exchanges(df):
    """The input columns of each shuffle of a plan."""
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]\nArguments: hashpartitioning", text)


def _events(spark, n=300):
    rng, start = random.Random(4), dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(hours=rng.randrange(600)), None if i % 41 == 0 else rng.randrange(9), rng.randrange(6), rng.randrange(5),
             float(rng.randrange(1, 900)), int(rng.random() < 0.2), 5.0, 1.0, i) for i in range(n)]
    return adapter._decorate(spark.createDataFrame(
        rows, "TX_ID long, TX_TS timestamp, CUSTOMER_ID long, TERMINAL_ID long, MERCHANT_ID long, TX_AMOUNT double, TX_FRAUD int, _goods double, _cashback double, _seed long"))


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_window_counts_take_one_shuffle_of_the_rows(spark, no_broadcast):
    d = _events(spark).select("TX_ID", "TX_TS", "CUSTOMER_ID")
    out = W.add_time_window_counts(d, "CUSTOMER_ID")
    assert len(_exchanges(out)) == 1
    rows = d.collect()
    for r in out.collect():
        for label, hours in (("24h", 24), ("7d", 168)):
            n = sum(x.CUSTOMER_ID == r.CUSTOMER_ID and (x.TX_TS, x.TX_ID) < (r.TX_TS, r.TX_ID) and x.TX_TS > r.TX_TS - dt.timedelta(hours=hours) for x in rows)
            assert r[f"count_{label}_CUSTOMER_ID"] == (0 if r.CUSTOMER_ID is None else n)


def test_hop_and_gap_come_of_one_history(spark, no_broadcast):
    d = _events(spark).select("TX_ID", "TX_TS", "CUSTOMER_ID", F.col("TX_AMOUNT").alias("x"), F.lit(0.0).alias("y"))
    one = W.add_prev_location(d, "CUSTOMER_ID", "x", "y", first_gap=1e9)
    two = W.add_prev_location(W.add_time_since_last(d, ["CUSTOMER_ID"], "_gap", 1e9), "CUSTOMER_ID", "x", "y", gap_col="_gap").drop("_gap")
    assert len(_exchanges(one)) == 1 < len(_exchanges(two))
    assert {r.TX_ID: r for r in one.collect()} == {r.TX_ID: r for r in two.select(*one.columns).collect()}


def test_many_rows_of_a_history_are_dealt_to_more_tasks(spark, no_broadcast, monkeypatch):
    from frauddeck.plans import q_windows as Q
    d = _events(spark)
    usual = {r.TX_ID: r for r in Q._incl(d).collect()}
    monkeypatch.setattr(Q, "ROWS_PER_TASK", 40)
    out = Q._incl(d)
    text = out._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(.*, 8\)", text)) == 2  # 300 rows; the session has 4 partitions
    assert not any("_tl2_cnt" in x for x in _exchanges(out)) and {r.TX_ID: r for r in out.collect()} == usual


def test_p3_shuffles_wide_rows_once(spark, no_broadcast):
    tx = _events(spark)
    place = lambda k, n: spark.range(n).select(F.col("id").alias(k), *[(F.col("id") * 3.0).alias(f"{a}_{k.lower()}") for a in "xy"])
    merchants = spark.range(4).select(F.col("id").alias("MERCHANT_ID"), *[F.lit("Ecommerce").alias(c) for c in ("MCC_CODE", "BUSINESS_TYPE", "OUTLET_TYPE", "TAX_EXCEMPT_INDICATOR")],
                                      F.lit("2015-01-01").cast("date").alias("FOUNDATION_DATE"), *[F.lit(20.0).alias(c) for c in P.P3_MERCHANT[5:]])
    customers = place("CUSTOMER_ID", 7)
    p3 = P.p3_unified_features(tx, customers.union(customers.where("CUSTOMER_ID = 2")), place("TERMINAL_ID", 5), merchants)
    assert sum("CARD_EXPIRY_DATE" in x and "x_customer_id" in x for x in _exchanges(p3)) == 0
    assert p3.count() == 300 + tx.where("CUSTOMER_ID = 2").count()  # a left join with a repeated key
    assert p3.where("CUSTOMER_ID >= 7 or CUSTOMER_ID is null").where("x_customer_id is not null").isEmpty()


def test_spatial_fits_read_cells_that_are_kept(spark, monkeypatch):
    seen = []

    def fit(cells, x, y):
        seen.append(cells._jdf.queryExecution().analyzed().toString())
        raise StopIteration
    monkeypatch.setattr(ml, "fit_spatial_surface", fit)
    tx = _events(spark)
    at = lambda k: tx.select(k).distinct().select(k, F.lit(1.0).alias(f"x_{k.lower()}"), F.lit(2.0).alias(f"y_{k.lower()}"))
    with pytest.raises(StopIteration):
        P.p10_spatial_risk(tx, at("CUSTOMER_ID"), at("TERMINAL_ID"))["rows"]()
    assert "Join" not in seen[0] and "Aggregate" not in seen[0]


def test_small_batches_share_a_job(spark, monkeypatch):
    rng = np.random.default_rng(5)
    d = spark.createDataFrame([(i, *map(float, x), int(x[0] > 0.3)) for i, x in enumerate(rng.normal(size=(600, 2)))], "TX_ID long, a double, b double, TX_FRAUD int")
    s = N.Settings(hidden=(6,), norms=(True,), dropout=(0.2,), batch=100, group=25, epochs=2, rate=0.02)
    jobs, summed = [], N._summed
    monkeypatch.setattr(N, "_summed", lambda *a: jobs.append(1) or summed(*a))
    together = N.fit(d.where("TX_ID < 500"), d.where("TX_ID >= 500"), ["a", "b"], settings=s)
    assert len(jobs) == 2  # the held-out rows' loss of each epoch
    monkeypatch.setattr(N, "TOGETHER", 0)
    alone = N.fit(d.where("TX_ID < 500"), d.where("TX_ID >= 500"), ["a", "b"], settings=s)
    assert len(jobs) == 2 + 2 * 6 and together.losses == pytest.approx(alone.losses, rel=1e-9)


def test_sums_of_a_task_take_little_more_than_their_result():
    rng, features = np.random.default_rng(6), list(range(0, 70, 2))
    ranges, slot = rng.integers(0, 256, (3000, 70)).astype(np.uint8), rng.integers(-1, 32, 3000)
    g, h = rng.integers(-1 << 30, 1 << 30, 3000), rng.integers(0, 1 << 20, 3000)
    tracemalloc.start()
    out = L.sums(ranges, g, h, slot, 32, features)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5 * out.nbytes
    for s, f, r in ((0, 3, 17), (31, 34, 255), (7, 0, 0)):
        use = (slot == s) & (ranges[:, features[f]] == r)
        assert out[s, f, :, r].tolist() == [g[use].sum(), h[use].sum(), use.sum()]


def _ap(rows):
    """Step AP of ``(score, positives, rows)``, ties together, None lowest, in plain Python."""
    by, total = {}, sum(p for _, p, _ in rows)
    for s, p, n in rows:
        k = (0, 0.0) if s is None else (2, 0.0) if s != s else (1, s + 0.0)
        by[k] = (by.get(k, (0, 0))[0] + p, by.get(k, (0, 0))[1] + n)
    cp = cn = ap = 0
    for k in sorted(by, reverse=True):
        cp, cn = cp + by[k][0], cn + by[k][1]
        ap += by[k][0] / total * cp / cn if total else 0
    return ap if total else None


@pytest.mark.parametrize("batch", [3, 10000])
def test_precisions_of_ties_nulls_and_values_that_go_on_in_the_next_batch(spark, batch):
    rng, old = random.Random(9), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        rows = [(k, rng.choice([None, float("nan"), -0.0, 0.0, 0.25, float(rng.randrange(40)), 7.0, 7.0]), None if (p := rng.randrange(3)) and k == 2 else p, p + rng.randrange(1, 4))
                for k in range(5) for _ in range(150)] + [(9, 0.5, 0, 2), (9, None, 0, 1)]
        got = globalrank.average_precisions(spark.createDataFrame(rows, "k int, s double, p int, n int"), "k", "s", "p", "n")
        assert dict(got.dtypes) == {"k": "int", "average_precision": "double"}
        want = {k: _ap([(s, p or 0, n) for q, s, p, n in rows if q == k]) for k in {r[0] for r in rows}}
        assert dict(got.collect()) == {k: v if v is None else pytest.approx(v, rel=1e-12) for k, v in want.items()}
        curve = spark.createDataFrame([(i % 2, [r[1], None, float(i % 7)]) for i, r in enumerate(rows)] + [(1, None), (1, [])], "TX_FRAUD int, margins array<double>")
        want = {t: _ap([(m[t], y or 0, 1) for y, m in curve.collect() if m]) for t in range(3)}
        assert dict(curves.ap_by_iteration(curve).collect()) == {t: pytest.approx(v, rel=1e-12) for t, v in want.items()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_precisions_keep_what_has_positives_and_shuffle_rows_once(spark, monkeypatch):
    """What is checkpointed is one row for each value with a positive and one for each range and key, and
    the plan over the rows has one shuffle, by ranges."""
    kept, real = [], type(spark.range(1)).checkpoint
    monkeypatch.setattr(type(spark.range(1)), "checkpoint", lambda d, *a, **k: kept.append((d, real(d, *a, **k))) or kept[-1][1])
    d = spark.range(2000).select((F.col("id") % 4).alias("k"), (F.col("id") / 2000.0).alias("s"), (F.col("id") % 100 == 0).cast("int").alias("p"), F.lit(1).alias("n"))
    globalrank.average_precisions(d, "k", "s", "p", "n")
    (plan, written), = kept
    text = plan._sc._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "simple")
    assert text.split("Initial Plan")[-1].count("Exchange") == 1 and "rangepartitioning" in text
    assert written.where("not _last").count() == 20 and 4 <= written.where("_last").count() <= 8


@pytest.mark.parametrize("rows_per_task", [500_000, 40])
def test_p3_shuffles_columns_only_where_they_are_needed(spark, no_broadcast, monkeypatch, rows_per_task):
    """Wide rows go by id alone (the category's share is joined by its few values), flags and dimensions join narrow rows."""
    monkeypatch.setattr(P, "ROWS_PER_TASK", rows_per_task)
    v = adapter.payments_view(spark, "/root/testdata/sf0.001")
    tx = _events(spark)
    lone = tx.where("TX_ID = 0").withColumns({"TX_ID": F.lit(None).cast("long"), "TERMINAL_ID": F.lit(77).cast("long"), "CUSTOMER_ID": F.lit(3).cast("long")})
    bad = tx.where("TX_ID < 5").withColumns({"TX_ID": F.col("TX_ID") + 1000, "TERMINAL_ID": F.lit(77).cast("long"), "TX_FRAUD": F.lit(1)})
    p3 = P.p3_unified_features(tx.unionByName(bad).unionByName(lone.withColumn("TX_FRAUD", F.lit(1))), v["customers"], v["terminals"], v["merchants"])
    wide = [x for x in _exchanges(p3) if "CARD_EXPIRY_DATE" in x]
    assert sum("MCC_CODE" not in x for x in wide) == 1 and sum("MCC_CODE" in x for x in wide) <= 1
    assert not any("_c_l10_mean" in x and ("MERCHANT_ID" in x or "_merchant" in x) for x in _exchanges(p3) if "CARD_EXPIRY_DATE" not in x)
    flags = {r[0]: r[1:] for r in p3.select("TX_ID", "is_fraudulent_terminal", "cust_tx_count_cumm", "x_customer_id").collect()}
    assert len(flags) == 306 and flags[None] == (1, None, None)  # no id: the terminal's flag, no history
    assert {k for k, f in flags.items() if f[0]} == {None, *range(1000, 1005)}
