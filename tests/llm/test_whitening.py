"""Whitening against plain arithmetic: exact products, eigenvectors, edge cases."""

import math

import numpy as np

from frauddeck.llm import vectors as V
from frauddeck.llm import whitening as W


def plain(rows, length, k=16):
    """Usable (id, whole numbers), the fit list's covariance and its eigenvalues."""
    used = [(i, tuple(math.floor(64 * float(c)) + 1_000_000 for c in v)) for i, v in rows
            if v is not None and len(v) == length and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in used})
    n = len(fit)
    s = [sum(x[d] for x in fit) for d in range(length)]
    centred = [[n * x[d] - s[d] for d in range(length)] for x in fit]
    v = np.array([[sum(c[i] * c[j] for c in centred) / n ** 3 for j in range(length)] for i in range(length)])
    return used, fit, n, s, v


def test_products_by_bit_planes_are_exact():
    rng = np.random.default_rng(5)
    for lo, hi, rows in ((-40, 40, 1), (-40, 40, 63), (0, 2, 64), (-5, 900, 1000), (-V.LIMIT, V.LIMIT, 70)):
        x = rng.integers(lo, hi, (rows, 5))
        sums, products = W.cross_products(x)
        o = x.astype(object)
        assert (sums == o.sum(axis=0)).all() and (products == o.T @ o).all()
    sums, products = W.cross_products(np.full((9, 3), 7))
    assert sums.tolist() == [63] * 3 and products.tolist() == [[441] * 3] * 3


def test_query_against_plain_arithmetic(spark, sf_dir):
    from frauddeck.llm.queries import QUERIES
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    out = QUERIES["op12_whitening"](spark, sf_dir).collect()
    length = len(rows[0][1])
    used, fit, n, s, v = plain(rows, length)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    assert len(out) == 16 * len(used)
    got = {(r.vec_id, r.component): r for r in out}
    of = dict(used)
    white = np.zeros((len(fit), 16))
    at = {x: i for i, x in enumerate(fit)}
    for (i, c), r in got.items():
        x = of[i]
        assert r.n == n and r.deviation == sum((n * a - b) ** 2 for a, b in zip(x, s))
        assert abs(r.explained / (values[c - 1] / v.trace()) - 1) < 1e-9 and r.identity_error <= 1e-9
        white[at[x], c - 1] = r.whitened
    assert np.abs(np.cov(white.T, bias=True) - np.eye(16)).max() < 1e-9
    for c in range(16):  # along the same axis, either way
        want = (np.array(fit) - np.array(s) / n) @ axes[:, c] / math.sqrt(values[c])
        assert min(np.abs(white[:, c] - want).max(), np.abs(white[:, c] + want).max()) < 1e-6


def test_unusable_rows_copies_and_clashing_names(spark):
    rng = np.random.default_rng(1)
    good = [(i, rng.normal(size=3).tolist(), "u") for i in range(60)]
    bad = [(100, None, "u"), (101, [1.0, None, 2.0], "u"), (102, [1.0, float("nan"), 2.0], "u"), (103, [1.0, 2.0, float("inf")], "u"), (104, [1.0], "u"), (105, [], "u")]
    rows = good + bad + good[:30] * 3 + [(None, good[0][1], "u")]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string").repartition(5)
    model = W.fit(d, "embedding")
    used, fit, n, s, v = plain([(i, e) for i, e, _ in rows], 3)
    assert (model.n, model.sums) == (n, s) and n <= 60
    assert np.allclose(np.sort(model.variances), np.linalg.eigh(v)[0], rtol=1e-12) and model.identity_error < 1e-9
    out = W.transform(d, model, "vec_id", "embedding")
    assert out.count() == 3 * len(used) and out.where("vec_id is null").count() == 3
    assert out.where("vec_id >= 100").count() == 0 and out.groupBy("vec_id", "component").agg({"whitened": "count"}).count() == 3 * 61


def test_flat_and_empty_tables(spark):
    kind = "vec_id long, embedding array<float>"
    empty = spark.createDataFrame([], kind)
    assert W.fit(empty, "embedding") is None and W.transform(empty, None, "vec_id", "embedding").count() == 0
    one = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], kind)
    assert W.fit(one, "embedding") is None
    line = spark.createDataFrame([(i, [float(i), 5.0, 2.0 * i]) for i in range(9)], kind)  # rank one
    model = W.fit(line, "embedding")
    assert len(model.variances) == 1 and W.transform(line, model, "vec_id", "embedding").count() == 9


def test_very_large_components(spark):
    rows = [(i, [1e30 * (i % 3 - 1), float(i), 3e9 * i]) for i in range(12)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = W.transform(d, W.fit(d, "embedding"), "vec_id", "embedding").collect()
    assert len(out) and all(r.deviation is None and math.isfinite(r.whitened) for r in out)
    half = spark.createDataFrame([(i, [2e6 * (i % 3 - 1), 1e6 * i]) for i in range(12)], "vec_id long, embedding array<double>")
    used, fit, n, s, _ = plain([(r.vec_id, r.embedding) for r in half.collect()], 2)
    out = W.transform(half, W.fit(half, "embedding"), "vec_id", "embedding").collect()
    want = {i: sum((n * a - b) ** 2 for a, b in zip(x, s)) for i, x in used}
    assert {r.vec_id: r.deviation for r in out} == {i: v if v < 1 << 63 else None for i, v in want.items()}
    assert any(v >= 1 << 63 for v in want.values()) and any(v < 1 << 63 for v in want.values())
