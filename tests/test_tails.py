"""p-values against closed forms, the truncated normal against known parameters, feature blocks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from frauddeck.operators import star, tails


def _student(r, n):
    """Two-sided tail by finite sums over the degrees of freedom."""
    v, theta, c2 = n - 2, math.asin(abs(r)), 1 - r * r
    if v % 2:
        total, term = 0.0, math.cos(theta)
        for k in range(1, (v - 1) // 2 + 1):
            total += term
            term *= 2 * k / (2 * k + 1) * c2
        return 1 - 2 / math.pi * (theta + abs(r) * total)
    total, term = 0.0, 1.0
    for k in range(1, v // 2 + 1):
        total += term
        term *= (2 * k - 1) / (2 * k) * c2
    return 1 - abs(r) * total


def test_p_values(spark):
    cases = [(r, n) for n in (3, 4, 5, 6, 7, 12, 31, 100, 1001, 60175, 600000) for r in (0.0, 1e-6, 0.001, 0.01, 0.05, 0.2, 0.5, 0.9, -0.3, 0.999)]
    d = spark.createDataFrame([(r, n) for r, n in cases] + [(0.5, 2), (1.0, 9), (-1.0, 9)], "r double, n long")
    got = {(x.r, x.n): x.p for x in d.select("r", "n", tails.pearson_p_value(F.col("r"), F.col("n")).alias("p")).collect()}
    for r, n in cases:
        want = _student(r, n)
        assert got[r, n] == pytest.approx(want, abs=1e-9), (r, n)
    assert got[0.5, 2] is None and got[1.0, 9] == 0.0 and got[-1.0, 9] == 0.0
    assert got[0.5, 1001] == pytest.approx(5.2e-65, rel=0.05)  # far tails keep their size


def test_p_value_table(spark):
    """Known values: t = 12.706 (1), 4.303 (2), 2.571 (5), 2.228 (10), 1.984 (100) leave 5 per cent."""
    for v, t in ((1, 12.7062047362), (2, 4.3026527297), (5, 2.5705818356), (10, 2.2281388520), (100, 1.9839715185)):
        r = t / math.sqrt(v + t * t)
        p = spark.range(1).select(tails.pearson_p_value(F.lit(r), F.lit(v + 2))).first()[0]
        assert p == pytest.approx(0.05, abs=1e-9)


def _cut_normal(mu, sigma, lo, hi, n, seed=4):
    rnd = random.Random(seed)
    out = []
    while len(out) < n:
        x = rnd.gauss(mu, sigma)
        if lo <= x <= hi:
            out.append(x)
    return out


@pytest.mark.parametrize("mu, sigma, lo, hi", [(0.0, 1.0, -1.0, 2.0), (220.0, 60.0, 100.0, 400.0), (-50.0, 80.0, 0.0, 300.0), (1e6, 5.0, 1e6 - 4, 1e6 + 30)])
def test_known_parameters_come_back(mu, sigma, lo, hi):
    """Moments of the exact distribution give its parameters; a sample gives them about."""
    m = tails._moments((mu - mu) / sigma, 1.0, (lo - mu) / sigma, (hi - mu) / sigma)
    n = 1000
    found = tails.fit_truncated_normal(n, n * m[0], n * m[1], (lo - mu) / sigma, (hi - mu) / sigma)
    assert found == pytest.approx((0.0, 1.0), abs=1e-6)
    x = _cut_normal(mu, sigma, lo, hi, 20000)
    c = sum(x) / len(x)
    found = tails.fit_truncated_normal(len(x), 0.0, sum((v - c) ** 2 for v in x), lo - c, hi - c)
    assert c + found[0] == pytest.approx(mu, abs=0.35 * sigma) and found[1] == pytest.approx(sigma, rel=0.15)


def test_moments_agree_with_sums():
    for mu, sigma, lo, hi in ((0.3, 0.7, -1.0, 1.0), (5.0, 2.0, -1.0, 1.0)):
        n = 20000
        xs = [lo + (hi - lo) * (i + 0.5) / n for i in range(n)]
        w = [math.exp(-((x - mu) ** 2) / (2 * sigma * sigma)) for x in xs]
        want = [sum(a * x ** k for a, x in zip(w, xs)) / sum(w) for k in range(1, 5)]
        assert tails._moments(mu, sigma, lo, hi) == pytest.approx(want, rel=1e-6)


def test_no_normal_to_fit(spark):
    assert tails.fit_truncated_normal(1, 0.0, 0.0, -1.0, 1.0) is None
    assert tails.fit_truncated_normal(9, 0.0, 9 * 0.9, -1.0, 1.0) is None  # wider than a uniform
    d = spark.createDataFrame([(1.0, 0)], "TX_AMOUNT double, TX_FRAUD int")
    assert tuple(tails.truncated_normal(d).first()) == (None, None, None, None, 0)
    x = [(v, 1) for v in _cut_normal(50, 20, 10, 120, 3000)]
    r = tails.truncated_normal(spark.createDataFrame(x, "TX_AMOUNT double, TX_FRAUD int")).first()
    assert abs(r["mu"] - 50) < 3 and abs(r["sigma"] - 20) < 2 and r["n"] == 3000


def test_concat_blocks(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "TX_ID long, x double")
    b = spark.createDataFrame([(2, "u"), (3, "v")], "TX_ID long, y string")
    got = {r["TX_ID"]: (r["x"], r["y"]) for r in star.concat_blocks([a, b]).collect()}
    assert got == {1: (1.0, None), 2: (2.0, "u"), 3: (None, "v")}
    with pytest.raises(ValueError):
        star.concat_blocks([a, b, a])
