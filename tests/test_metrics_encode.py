"""Metrics (tie rules, one class), encoders (unseen categories), splits, score alignment."""

import random

import pytest
from pyspark.sql import functions as F

from frauddeck.operators import encode, globalrank, metrics, split, star


def _brute_auc(rows):
    pos = [p for y, p in rows if y == 1]
    neg = [p for y, p in rows if y == 0]
    s = sum((1.0 if a > b else 0.5 if a == b else 0.0) for a in pos for b in neg)
    return s / (len(pos) * len(neg))


def test_auc_ties_and_one_class(spark):
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 1), round(rnd.random(), 1)) for _ in range(300)]
    df = spark.createDataFrame(rows, "y int, p double")
    assert abs(metrics.roc_auc(df).first()[0] - _brute_auc(rows)) < 1e-12
    one = spark.createDataFrame([(1, 0.3), (1, 0.9)], "y int, p double")
    assert metrics.roc_auc(one).first()[0] == 0.5


def test_average_precision_step(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.7), (1, 0.1)]
    df = spark.createDataFrame(rows, "y int, p double")
    # thresholds 0.9: P=1 R=1/3; 0.8: P=1/2 R=1/3; 0.7: P=2/4 R=2/3; 0.1: P=3/5 R=1
    expected = (1 / 3) * 1 + 0 + (1 / 3) * 0.5 + (1 / 3) * 0.6
    assert abs(metrics.average_precision(df).first()[0] - expected) < 1e-12


def test_avg_rank_pct_matches_pandas(spark):
    import pandas as pd
    vals = [3.0, 1.0, 3.0, 2.0, 3.0, None, 1.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v double")
    got = dict(globalrank.with_avg_rank_pct(df, "v", "r").select("i", "r").collect())
    ref = pd.Series(vals).rank(pct=True)
    for i, v in enumerate(ref):
        assert (got[i] is None and pd.isna(v)) or abs(got[i] - v) < 1e-12


def test_exact_quantile_grouped(spark):
    import numpy as np
    rnd = random.Random(5)
    rows = [(f"k{rnd.randint(0, 3)}", float(rnd.randint(0, 50))) for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = dict(globalrank.exact_quantile(df, "v", 0.5, keys=["k"]).collect())
    for k in got:
        assert abs(got[k] - float(np.quantile([v for kk, v in rows if kk == k], 0.5))) < 1e-12


def test_label_codes_unseen(spark):
    tr = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "c string")
    te = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    m = encode.fit_codes(tr, "c")
    got = [r[0] for r in encode.apply_codes(te, "c", m, unseen="minus_one", out="code").select("code").collect()]
    assert sorted(got) == sorted([1, -1, 0])  # sorted classes: __NA__=0, a=1, b=2
    got_n = [r[0] for r in encode.apply_codes(te, "c", m, unseen="n_classes", out="code").select("code").collect()]
    assert 3 in got_n


def test_oof_target_encoding_excludes_own_fold(spark):
    rows = [(i, "x" if i < 6 else "y", i % 2, i % 3) for i in range(12)]
    df = spark.createDataFrame(rows, "id int, c string, TX_FRAUD int, fold int")
    out = {r["id"]: r["c_te"] for r in encode.out_of_fold_target_encode(df, "c").collect()}
    for i, c, y, f in rows:
        other = [yy for ii, cc, yy, ff in rows if cc == c and ff != f]
        assert abs(out[i] - sum(other) / len(other)) < 1e-12


def test_stratified_kfold_balanced(spark):
    df = spark.range(1000).select(F.col("id").alias("TX_ID"), (F.col("id") % 10 == 0).cast("int").alias("TX_FRAUD"))
    f = split.stratified_kfold(df, 5).groupBy("fold", "TX_FRAUD").count().collect()
    assert {(r["fold"], r["TX_FRAUD"]): r["count"] for r in f}[(0, 1)] == 20


def test_align_scores_no_overlap_raises(spark):
    a = spark.createDataFrame([("1", 0.2)], "TX_ID string, TX_FRAUD double")
    b = spark.createDataFrame([("2", 0.4)], "TX_ID string, TX_FRAUD double")
    with pytest.raises(ValueError):
        star.align_scores(a, b, require_overlap=True)
    with pytest.raises(ValueError):
        star.align_scores(a.drop("TX_FRAUD"), b)
