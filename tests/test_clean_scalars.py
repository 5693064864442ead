"""Cleaning rules and scalar functions against the hand-made cases (FIXTURES 4)."""

import datetime as dt

from pyspark.sql import functions as F

from frauddeck.functions import scalars as S
from frauddeck.operators import clean


def test_fuzzy_bool(spark):
    vals = [" True ", "Fals", "Y", "n", "1", "maybe", None, "yes", "false", "t"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(S.fuzzy_bool("v")).collect()]
    assert got == [True, False, True, False, True, False, False, True, False, True]


def test_expiry_parse(spark):
    vals = ["07/23", "13/23", "00/24", "7/2", "xx", None, "1/2/3"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    m, y = S.expiry_month_year("v")
    got = [(r[0], r[1]) for r in df.select(m, y).collect()]
    assert got == [(7.0, 2023.0), (None, None), (None, None), (7.0, 2002.0), (None, None), (None, None),
                   (None, None)]


def test_rescale_goods_cashback(spark):
    df = spark.createDataFrame([(100.0, 90.0, 20.0), (0.0, 0.0, 0.0), (0.0, 5.0, 5.0), (50.0, 10.0, 10.0)],
                               "a double, g double, c double")
    g, c = S.rescale_parts("g", "c", "a")
    got = [(round(r[0], 6), round(r[1], 6)) for r in df.select(g, c).collect()]
    assert got == [(round(90 * 100 / 110, 6), round(20 * 100 / 110, 6)), (0.0, 0.0), (0.0, 0.0), (10.0, 10.0)]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(-5.0,), (150.0,), (None,), (42.0,)], "x double")
    assert [r[0] for r in df.select(S.clip("x", 0.0, 100.0)).collect()] == [0.0, 100.0, None, 42.0]


def test_dedup_latest_and_nulls(spark):
    rows = [("t1", dt.datetime(2024, 1, 1), "c1", "T1", 5.0), ("t1", dt.datetime(2024, 1, 3), "c1", "T1", 7.0),
            ("t2", dt.datetime(2024, 1, 2), None, "T1", 1.0), ("t3", dt.datetime(2024, 1, 2), "c2", "T2", None)]
    df = spark.createDataFrame(rows, "TX_ID string, TX_TS timestamp, CUSTOMER_ID string, TERMINAL_ID string, TX_AMOUNT double")
    out = {r["TX_ID"]: r for r in clean.clean_transactions(df).collect()}
    assert set(out) == {"t1", "t3"}  # t2 has a null customer
    assert out["t1"]["TX_AMOUNT"] == 7.0 and out["t3"]["TX_AMOUNT"] == 0.0


def test_weekday_and_floor_days(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 12), dt.datetime(2024, 1, 3, 6))], "a timestamp, b timestamp")
    r = df.select(S.weekday("a"), S.floor_days("a", "b"), S.floor_days("b", "a")).first()
    assert r[0] == 0 and r[1] == -2 and r[2] == 1  # Monday = 0; days floor toward -inf


def test_hour_risk_and_flags(spark):
    df = spark.createDataFrame([(h,) for h in range(24)], "h int")
    got = [r[0] for r in df.select(S.hour_risk("h")).collect()]
    assert got == S.HOUR_RISK
    assert df.select(F.sum(S.in_flag("h", S.HIGH_RISK_HOURS))).first()[0] == 5
