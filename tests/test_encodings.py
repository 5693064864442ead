"""P2 and P4 read their rows once for all encodings; the folds of a search are fitted at the same time."""

import threading

import pytest
from pyspark.sql import functions as F

from frauddeck.operators import encode, ml
from frauddeck.plans import pipelines as P
from tests.test_pipelines import _jobs
from tests.test_shuffles import _events


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(i, i % 5, int(i % 7 == 0), "abc"[i % 3], None if i % 11 == 0 else str(i % 4)) for i in range(200)],
                                 "TX_ID long, fold int, TX_FRAUD int, a string, b string")


def _dims(spark):
    place = lambda k, n: spark.range(n).select(F.col("id").alias(k), *[(F.col("id") * 3.0).alias(f"{a}_{k.lower()}") for a in "xy"])
    merchants = spark.range(4).select(F.col("id").alias("MERCHANT_ID"), *[F.concat(F.lit(c), F.col("id") % 2).alias(c) for c in ("MCC_CODE", "BUSINESS_TYPE", "OUTLET_TYPE", "TAX_EXCEMPT_INDICATOR")],
                                      F.lit("2015-01-01").cast("date").alias("FOUNDATION_DATE"), F.lit(9.0).alias("ANNUAL_TURNOVER"), *[F.lit(20.0).alias(c) for c in P.P2_MERCHANT[4:]])
    return place("CUSTOMER_ID", 7), place("TERMINAL_ID", 5), merchants


def test_codes_of_one_pass_are_those_of_each_column(rows):
    counts = encode.value_counts(rows, ["a", "b"])
    for c, codes in encode.codes_of(counts, ["a", "b"]).items():
        assert {tuple(r) for r in codes.select("_value", "code", "n_classes").collect()} == {tuple(r) for r in encode.fit_codes(rows, c).select("_value", "code", "n_classes").collect()}
    a, b = (encode.log_count_encode(rows, ["a", "b"], **k).orderBy("TX_ID").collect() for k in ({"reference": rows}, {"counts": counts}))
    assert a == b


def test_out_of_fold_tables_hold_the_rows_encodings(rows):
    d = rows.fillna("0")
    for c, table in encode.out_of_fold_tables(d, ["a", "b"], alpha=10.0).items():
        want = encode.out_of_fold_target_encode(d, c, alpha=10.0).groupBy(c, "fold").agg(F.first(f"{c}_te"), F.count(F.lit(1)))
        got = lambda x: {r[:2]: (pytest.approx(r[2]), r[3]) for r in map(tuple, x.collect())}
        assert {r[:2]: r[2:] for r in map(tuple, table.collect())} == got(want)


def test_p2_and_p4_start_few_jobs_and_read_their_source_once(spark):
    tx, dims = _events(spark), _dims(spark)
    assert _jobs(spark, "p2", lambda: P.p2_feature_table_v1(tx, *dims)) < 60
    half = F.col("TX_ID") < 150
    assert _jobs(spark, "p4", lambda: P.p4_history_and_target_encoding(tx.filter(half), tx.filter(~half), *dims)) < 170
    plan = P.p2_feature_table_v1(tx, *dims)._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD [TX_ID" not in plan  # the given rows


def test_rows_without_id_or_with_a_dimension_twice(spark):
    customers, terminals, merchants = _dims(spark)
    tx = _events(spark).withColumn("TX_ID", F.when(F.col("TX_ID") != 3, F.col("TX_ID")))
    d = P.p2_feature_table_v1(tx, customers.union(customers.where("CUSTOMER_ID = 2")), terminals, merchants)
    assert d.count() == 300 + tx.where("CUSTOMER_ID = 2 and TX_ID is not null").count() + tx.where("CUSTOMER_ID = 2 and TX_ID is null").count()
    lost = d.where("TX_ID is null").first()
    assert lost.z_amt_CUSTOMER_ID is None and lost.count_24h_TERMINAL_ID is None and lost.x_terminal_id is not None


def test_folds_of_a_search_are_fitted_at_the_same_time(spark, monkeypatch):
    d = spark.createDataFrame([(i, i % 5, i % 2, float(i % 9)) for i in range(100)], "TX_ID long, fold int, TX_FRAUD int, x double")
    together, real, model = threading.Barrier(4, timeout=60), ml.fit_gbt, []

    def fit(train, features, label="TX_FRAUD", **k):
        together.wait()  # breaks if the folds come one after another
        if not model:
            model.append(real(train, features, label, max_iter=1, max_depth=2))
        return model[0]

    monkeypatch.setattr(ml, "fit_gbt", fit)
    found = ml.search_time_folds(d, ["x"], params=[{"max_iter": 1}, {"max_iter": 2}]).collect()
    assert sorted(r.param_id for r in found) == [0, 1] and all(0 <= r.mean_auc <= 1 for r in found)
