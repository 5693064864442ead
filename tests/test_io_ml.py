"""Sources/sinks (A1, A3, A4, A6, A7, A8, A9, A11) and a small Spark ML round trip."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from frauddeck.operators import encode, metrics, ml
from frauddeck.sources import io


def test_typed_csv_roundtrip_and_missing(spark):
    d = tempfile.mkdtemp(prefix="fd-io-")
    p = os.path.join(d, "preds.csv")
    with open(p, "w") as f:
        f.write("TX_ID,TX_FRAUD\na,0.2\nb,oops\n")
    df = io.read_csv_typed(spark, p, io.PREDICTIONS)
    assert [r["TX_FRAUD"] for r in df.orderBy("TX_ID").collect()] == [0.2, None]
    io.require_columns(df, ["TX_ID", "TX_FRAUD"])
    with pytest.raises(ValueError):
        io.require_columns(df, ["TX_ID", "SCORE"])
    with pytest.raises(FileNotFoundError):
        io.read_csv_typed(spark, os.path.join(d, "nope.csv"), io.PREDICTIONS).collect()
    io.write_table(df, os.path.join(d, "out_csv"), fmt="csv")
    assert spark.read.option("header", True).csv(os.path.join(d, "out_csv")).count() == 2


def test_stage_reuse_and_mappings(spark):
    root = tempfile.mkdtemp(prefix="fd-stage-")
    calls = []

    def build():
        calls.append(1)
        return spark.range(10).withColumn("x", F.col("id") * 2)

    a = io.stage(spark, "s1", build, root)
    b = io.stage(spark, "s1", build, root)
    assert a.count() == b.count() == 10 and len(calls) == 1
    assert io.list_stages(spark, root) == ["s1"]
    m = encode.fit_codes(spark.createDataFrame([("a",), ("b",)], "c string"), "c")
    io.write_mappings({"c": m}, os.path.join(root, "maps"))
    assert spark.read.json(os.path.join(root, "maps")).count() == 2


def test_sample_exact_is_repeatable(spark):
    df = spark.range(1000).withColumnRenamed("id", "TX_ID")
    a = [r[0] for r in io.sample_exact(df, 25, seed=7).collect()]
    b = [r[0] for r in io.sample_exact(df, 25, seed=7).collect()]
    assert len(a) == 25 and a == b


def test_gbt_fit_score_override_importance(spark):
    rows = [(i, float(i % 10), float((i * 7) % 13), 1 if i % 10 >= 7 else 0) for i in range(300)]
    df = spark.createDataFrame(rows, "TX_ID int, f1 double, f2 double, TX_FRAUD int")
    model = ml.fit_gbt(df, ["f1", "f2"], max_iter=5, max_depth=3)
    sc = ml.score(model, df)
    auc = metrics.roc_auc(sc.join(df.select("TX_ID", F.col("TX_FRAUD").alias("y")), "TX_ID"), "TX_FRAUD", "y")
    assert auc.first()[0] > 0.95
    flagged = sc.withColumn("bad", (F.col("TX_ID") == 0).cast("int"))
    assert ml.override_known_bad(flagged, "bad").filter("TX_ID = 0").first()["TX_FRAUD"] >= 0.95
    imp = ml.feature_importance(model, ["f1", "f2"]).collect()
    assert imp[0]["feature"] == "f1"
    d = tempfile.mkdtemp(prefix="fd-model-")
    io.save_model(model, os.path.join(d, "m"))
    assert io.load_pipeline_model(os.path.join(d, "m")).transform(df).count() == 300
