"""The bounded blend search against the grid and a plain Python run of the same search."""

import math
import random

import pytest

from frauddeck.operators import blend as M, globalrank


def _rows(n=260):
    rnd = random.Random(6)
    rows = []
    for _ in range(n):
        y = int(rnd.random() < 0.3)
        rows.append((round(min(max(rnd.gauss(0.35 + 0.25 * y, 0.2), 0.01), 0.99), 2), round(min(max(rnd.gauss(0.4 + 0.2 * y, 0.25), 0.01), 0.99), 2), y))
    return rows


def _plain_ap(rows, point):
    w1, w2, w3, t1, t2 = point
    total = w1 + w2 + w3
    w1, w2, w3 = w1 / total, w2 / total, w3 / total
    logit = lambda p: math.log(p / (1 - p + 1e-8) + 1e-8)
    by = {}
    for a, b, y in rows:
        x, z = 1 / (1 + math.exp(-logit(a) / t1)), 1 / (1 + math.exp(-logit(b) / t2))
        s = w1 * (w1 * x + w2 * z) + w2 * (x ** w1 * z ** w2) + w3 / (w1 / x + w2 / z + 1e-8)
        n, p = by.get(s, (0, 0))
        by[s] = (n + 1, p + y)
    n = p = ap = 0
    P = sum(y for *_, y in rows)
    for s in sorted(by, reverse=True):
        n, p = n + by[s][0], p + by[s][1]
        ap += by[s][1] / P * p / n
    return ap


def test_solver_beats_the_grid_and_its_point_holds(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "p_a double, p_b double, y int")
    best = M.solve_blend(df, tolerance=0.05, rounds=12)
    point = tuple(best[c] for c in ("w1", "w2", "w3", "t1", "t2"))
    assert best["average_precision"] == pytest.approx(_plain_ap(rows, point), abs=1e-9)
    grid = max(_plain_ap(rows, p) for p in M.default_grid())
    assert best["average_precision"] >= grid - 1e-12
    assert all(lo <= v <= hi for v, (lo, hi) in zip(point, M.BLEND_BOUNDS)) and best["rounds"] <= 12
    # no neighbour at the last step is better by plain arithmetic
    steps = [(hi - lo) * 0.0625 for lo, hi in M.BLEND_BOUNDS]
    if best["rounds"] < 12:
        assert all(_plain_ap(rows, p) <= best["average_precision"] + 1e-9 for p in M.neighbours(point, steps, M.BLEND_BOUNDS))


def test_neighbours_stay_within_bounds():
    got = M.neighbours((0.1, 0.8), [0.2, 0.2], [(0.1, 0.8), (0.1, 0.8)])
    assert got == [(pytest.approx(0.3), 0.8), (0.1, pytest.approx(0.6))]


def test_points_are_scored_in_every_partition_of_a_shuffle(spark):
    """Few bytes of pairs would be one task; each pair is scored for every point, so they are spread."""
    pairs = M._score_pairs(spark.createDataFrame(_rows(), "p_a double, p_b double, y int"), "p_a", "p_b", "y")
    assert pairs.rdd.getNumPartitions() == globalrank.default_parts(pairs)
    assert pairs.rdd.glom().map(len).filter(bool).count() == globalrank.default_parts(pairs)
