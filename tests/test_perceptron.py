"""The perceptron's sums and training against Spark ML's own classifier."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.sql import functions as F

from frauddeck.operators import ml, perceptron as P

SIZES = [3, 4, 2]


def _rows(spark, n=400):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 3))
    return spark.createDataFrame([(i, *map(float, r), int(r[0] * r[1] + 0.3 * e > 0.2)) for i, (r, e) in enumerate(zip(x, rng.normal(size=n)))],
                                 "TX_ID long, a double, b double, c double, TX_FRAUD int")


def _loss(model, df, factor):
    p, w = ml.prob1(), F.when(F.col("TX_FRAUD") == 1, factor).otherwise(1)
    return model.transform(df).agg(F.sum(-w * F.log(F.when(F.col("TX_FRAUD") == 1, p).otherwise(1 - p))) / F.sum(w)).first()[0]


def test_gradient_and_weights_of_a_block():
    rng = np.random.default_rng(1)
    flat, x, y = rng.normal(size=26), rng.normal(size=(9, 3)), rng.integers(0, 2, 9)
    f = lambda v, w=np.ones(9): P.loss_and_gradient(v, SIZES, x, y, w)
    for i in range(26):
        e = np.eye(26)[i] * 1e-6
        assert f(flat)[1][i] == pytest.approx((f(flat + e)[0] - f(flat - e)[0]) / 2e-6, abs=1e-6)
    often = np.where(y == 1, 3, 1)
    again = P.loss_and_gradient(flat, SIZES, np.repeat(x, often, axis=0), np.repeat(y, often), np.ones(often.sum()))
    weighed = f(flat, often.astype(float))
    assert weighed[0] == pytest.approx(again[0]) and weighed[1] == pytest.approx(again[1])


def test_training_ends_as_low_as_the_classifiers(spark):
    d, cols = _rows(spark), ["a", "b", "c"]
    spark_ml = Pipeline(stages=[ml.assembler(cols), StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True),
                                MultilayerPerceptronClassifier(labelCol="TX_FRAUD", featuresCol="scaled", layers=[3, 6, 2], maxIter=40, seed=42)])
    theirs = spark_ml.fit(ml.oversample_positives(d, "TX_FRAUD", 3))
    assert _loss(ml.fit_mlp(d, cols, hidden=(6,), max_iter=40, oversample=3), d, 3) < 1.05 * _loss(theirs, d, 3)
    first = ml.fit_mlp(d, cols, hidden=(6,), max_iter=0, oversample=3)
    scaler = first.stages[1]
    blocks = P.packed(d, cols, "TX_FRAUD", scaler.mean.toArray(), 1 / scaler.std.toArray(), 3)
    assert P.evaluation(blocks, [3, 6, 2])(first.stages[-1].weights.toArray())[0] == pytest.approx(_loss(first, d, 3), rel=1e-5)


@pytest.mark.parametrize("bad", ["cast(null as int)", "2"])
def test_labels_other_than_0_and_1_are_refused(spark, bad):
    with pytest.raises(Exception):
        ml.fit_mlp(_rows(spark, 20).withColumn("TX_FRAUD", F.expr(f"if(TX_ID = 3, {bad}, TX_FRAUD)")), ["a", "b"], hidden=(2,), max_iter=1)
