"""Pipelines against the oracle-checked queries, on repeated ids, and their arguments."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from frauddeck.plans import pipelines as P
from frauddeck.plans.common import views
from frauddeck.sources import adapter

SF = "/root/testdata/sf0.01"


def _round(df, cols):
    return {r["TX_ID"]: tuple(None if r[c] is None else float(r[c]) for c in cols) for r in df.collect()}


def _close(a, b, tol=1e-4):  # query outputs are rounded to 4-6 digits
    assert a.keys() == b.keys()
    for k in a:
        for x, y in zip(a[k], b[k]):
            assert (x is None and y is None) or abs(x - y) <= tol * max(1.0, abs(y)), (k, a[k], b[k])
    return True


def test_p3_matches_individual_window_queries(spark):
    v = adapter.payments_view(spark, SF, "lineitem")
    p3 = P.p3_unified_features(v["transactions"], v["customers"], v["terminals"], v["merchants"], bad_threshold=0.5)
    q = E.queries()
    e5 = q["e5_e17_prior_expanding_stats_ties"](spark, SF)
    cols = ["cust_avg_amount_cumm", "cust_std_amount_cumm", "amount_deviation", "amount_to_max_ratio"]
    a = _round(p3.select("TX_ID", *cols), cols)
    b = _round(e5.select("TX_ID", *cols), cols)
    assert _close(a, b)
    e14 = q["e14_amount_pct_in_merchant"](spark, SF)
    assert _close(_round(p3.select("TX_ID", "amount_percentile_merchant"), ["amount_percentile_merchant"]),
                  _round(e14, ["amount_percentile_merchant"]))
    e8 = q["e8_e9_e10_inclusive_rolling_ties"](spark, SF)
    cols = ["cust_amount_rolling_mean", "cust_tx_velocity_1h", "cust_tx_velocity_24h", "term_tx_velocity_1h"]
    assert _close(_round(p3.select("TX_ID", *cols), cols), _round(e8.select("TX_ID", *cols), cols))


def test_p3_one_row_per_transaction(spark):
    v = adapter.payments_view(spark, SF)
    p3 = P.p3_unified_features(v["transactions"], v["customers"], v["terminals"], v["merchants"])
    n, d = p3.agg(F.count(F.lit(1)), F.countDistinct("TX_ID")).first()
    assert n == d == v["transactions"].count()
    assert len(p3.columns) > 100


def test_a_repeated_tx_id_yields_one_row(spark):
    """P2, P3 and P7 join their blocks on TX_ID; repeated ids must not multiply."""
    v = views(spark, SF)
    t = v["transactions"].filter("TX_ID < 60")
    twice = t.unionByName(t.filter("TX_ID = 7")).unionByName(t.filter("TX_ID = 7").withColumn("TX_AMOUNT", F.col("TX_AMOUNT") + 1))
    n = t.count()
    for d in (P.p3_unified_features(twice, v["customers"], v["terminals"], v["merchants"]),
              P.p2_feature_table_v1(twice, v["customers"], v["terminals"], v["merchants"]), P.p7_customer_behaviour(twice)):
        got = d.select("TX_ID").collect()
        assert len(got) == n == len({r[0] for r in got})


def test_override_needs_its_flag(spark):
    d = spark.createDataFrame([(i, i % 2, float(i)) for i in range(20)], "TX_ID long, TX_FRAUD int, x double")
    with pytest.raises(KeyError):
        P.p8_train_score_submit(d, d, ["x"], k=2)


def test_scored_rows_do_not_see_their_labels(spark):
    """A terminal whose rows are all fraud, all among the scored ones, is not flagged; one that was bad
    in training is. Median and shares come from the training rows."""
    v = views(spark, SF)
    t = v["transactions"].filter("TX_ID < 400")
    order = [r[0] for r in t.orderBy("TX_TS", "TX_ID").select("TX_ID").collect()]
    late, early = order[-8:], order[:8]
    t = t.withColumn("TERMINAL_ID", F.when(F.col("TX_ID").isin(late), 990001).when(F.col("TX_ID").isin(early), 990002).otherwise(F.col("TERMINAL_ID")))
    t = t.withColumn("TX_FRAUD", F.when(F.col("TX_ID").isin(late + early), 1).otherwise(F.col("TX_FRAUD")))
    t = t.withColumn("TX_AMOUNT", F.when(F.col("TX_ID").isin(order[-80:]), 1e6).otherwise(F.col("TX_AMOUNT")))
    out = P.time_split_features(t, v["customers"], v["terminals"], v["merchants"])
    rows = {r["TX_ID"]: r for r in out.select("TX_ID", "is_train", "is_fraudulent_terminal", "cust_max_amount_cumm", "cust_tx_count_cumm").collect()}
    assert len(rows) == 400 and {i for i in rows if not rows[i]["is_train"]} == set(order[-80:])
    assert all(rows[i]["is_fraudulent_terminal"] == 0 for i in late) and all(rows[i]["is_fraudulent_terminal"] == 1 for i in early)
    firsts = [r["cust_max_amount_cumm"] for r in rows.values() if r["cust_tx_count_cumm"] == 1]
    train = sorted(r[0] for r in t.filter(F.col("TX_ID").isin(order[:320])).select("TX_AMOUNT").collect())
    assert set(firsts) == {(train[159] + train[160]) / 2}


def test_seed_bagging_uses_the_given_subsample(spark, monkeypatch):
    from frauddeck.operators import ml
    seen = []
    real = ml.fit_gbt
    monkeypatch.setattr(ml, "fit_gbt", lambda *a, **k: seen.append(k) or real(*a, **k))
    d = spark.createDataFrame([(i, i % 2, float(i)) for i in range(20)], "TX_ID long, TX_FRAUD int, x double")
    out = ml.seed_bagging(d, d, ["x"], seeds=(0, 1), subsample=0.5, max_iter=1, max_depth=2)
    assert [k["subsample"] for k in seen] == [0.5, 0.5] and out.count() == 20
    weighted = ml.fit_gbt(d.withColumn("w", F.lit(2.0)).withColumn("v", F.col("TX_ID") % 4 == 0), ["x"], weight_col="w", validation_col="v", max_iter=3)
    assert ml.score(weighted, d).count() == 20


def test_one_hot_vector_of_any_cardinality(spark):
    from frauddeck.operators import encode
    d = spark.createDataFrame([(i, f"v{i}" if i % 7 else None) for i in range(1500)], "TX_ID long, c string")
    out = encode.one_hot_vector(d, ["c"])
    assert out.count() == 1500 and out.first()["c_vec"].size == 1500 - 215 + 1


def test_checkpoint_folder_must_be_set_on_a_cluster():
    from frauddeck import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())


def test_model_queries_train_with_the_operators_settings(spark, monkeypatch):
    """Drawn rounds, five folds, class weights, early stop and all of P3's numeric columns reach the trainer."""
    import os

    from frauddeck.operators import ml
    from frauddeck.plans import q_pipelines as Q
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    real, staged, seen, kept = ml.fit_gbt, Q._staged(spark, sf), [], []

    def fit(train, features, label="TX_FRAUD", **k):
        seen.append((len(features), k, train))
        if not kept:
            kept.append(real(train, features, label, **{**k, "max_iter": 1, "max_depth": 2}))
        return kept[0]

    monkeypatch.setattr(Q, "_staged", lambda *a, **k: staged)
    monkeypatch.setattr(ml, "fit_gbt", fit)
    Q.k4_random_search_time_folds(spark, sf)
    assert len(seen) == 10 * 4 and [k["max_iter"] for _, k, _ in seen[::4]] == [p["max_iter"] for p in ml.random_param_sets(10, seed=1)]
    Q.k1_k11_gbt_validation_scores(spark, sf)
    Q.k6_seed_bagging(spark, sf)
    assert len(seen) == 46 and all({"max_iter", "max_depth"}.isdisjoint(k) for _, k, _ in seen[40:])
    assert all(n > 90 and k["weight_col"] == "_weight" and k["validation_col"] == "_valid" for n, k, _ in seen)
    assert seen[0][2].groupBy("_valid").count().count() == 2
    from frauddeck.operators import leafwise
    small, fitted = leafwise.fit(staged.limit(50), ["TX_AMOUNT_log"], settings=leafwise.Settings(rounds=1)), []
    monkeypatch.setattr(leafwise, "fit", lambda d, features, label, **k: fitted.append((len(features), k, d)) or small)
    Q.p8_submission(spark, sf)
    assert len(fitted) == 5 and all(n > 90 and k["valid"] == "_valid" and k["settings"] is Q.BOOSTING for n, k, _ in fitted)
    assert fitted[0][2].groupBy("_valid").count().count() == 2


def _jobs(spark, name, run):
    """How many jobs a call starts."""
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    run()
    found = len(sc.statusTracker().getJobIdsForGroup(name))
    sc.setJobGroup("", "")
    return found


def test_reports_start_no_other_reports_jobs(spark):
    import os
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    q = E.queries()
    for name in ("p6_by_hour", "p10_customer_cells", "p10_terminal_cells", "p11_by_type", "p11_moments"):
        q[name](spark, sf)  # reads the tables' schemas, once
        assert _jobs(spark, name, lambda n=name: q[n](spark, sf)) == 0, name


def test_every_report_of_p6_p10_and_p11_is_a_query(spark):
    import os
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    q = E.queries()
    assert sum(n.startswith("p6_") for n in q) == 10 and sum(n.startswith("p11_") for n in q) == 9 and sum(n.startswith("p10_") for n in q) == 4
    for n in q:
        if n.startswith(("p6_", "p11_")):
            assert q[n](spark, sf).count() or n.endswith("top20"), n  # those have a least count
    rows = q["p10_rows"](spark, sf)
    assert rows.count() == spark.read.parquet(f"{sf}/lineitem.parquet").count() and not rows.where("combined_area_risk is null").count()
    assert q["p10_customer_cells"](spark, sf).count() and q["p10_terminal_cells"](spark, sf).count()
