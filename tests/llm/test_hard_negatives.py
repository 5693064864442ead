"""Hard negatives against brute force: whole table, small leaves and blocks, ties, copies, edge cases."""

import math

import numpy as np
from pyspark.sql import functions as F

from frauddeck.llm import hard_negatives as H


def plain(rows, is_anchor, scale=256, positives=5, negatives=10, low=30, high=90):
    length = {}
    for _, v, _ in rows:
        if v:
            length[len(v)] = length.get(len(v), 0) + 1
    usual = min(length, key=lambda k: (-length[k], k)) if length else 0
    used = [(i, [math.floor(scale * float(c)) for c in v], y) for i, v, y in rows
            if i is not None and y is not None and v is not None and len(v) == usual and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for a, (i, x, y) in enumerate(used):
        if not is_anchor(i):
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, z)), j, other) for b, (j, z, other) in enumerate(used) if b != a)
        for s, p, _ in [t for t in scored if t[2] == y][:positives]:
            near = [(j, -t) for t, j, other in scored if other != y and 30 * -s <= 100 * -t <= 90 * -s]
            out += [(i, p, r + 1, j, -s, t) for r, (j, t) in enumerate(near[:negatives])]
    return sorted(out, key=str)


def mined(spark, d, mod, **k):
    index = H.build(d, leaf=k.pop("leaf", H.LEAF))
    return sorted([tuple(r) for r in H.mine(index, spark, F.col("id") % mod == 0, **k).collect()], key=str)


def test_query_against_brute_force(spark, sf_dir):
    from frauddeck.llm.queries import QUERIES
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = plain(rows, lambda i: i % 100 == 0)
    assert want and sorted([tuple(r) for r in QUERIES["op13_hard_negatives"](spark, sf_dir).collect()], key=str) == want


def test_small_leaves_trees_and_blocks(spark, monkeypatch):
    """Clustered vectors of few values: many ties, copies and negative scores; boxes do prune."""
    monkeypatch.setattr(H, "TREE", 5)
    monkeypatch.setattr(H, "FANOUT", 2)
    rng = np.random.default_rng(3)
    centres = rng.integers(-2, 3, (6, 4))
    rows = [(i, [float(c) / 256 for c in centres[i % 6] * 8 + rng.integers(-1, 2, 4)], i % 3) for i in range(240)]
    rows += [(1000 + i, rows[5][1], 1) for i in range(60)]  # one vector many times
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    want = plain(rows, lambda i: i % 10 == 0)
    assert want and mined(spark, d, 10, leaf=7, anchors=9) == want


def test_boxes_prune(monkeypatch):
    """Leaves that can't hold a better row aren't looked at."""
    rows = []
    for k in range(8):  # eight far apart leaves along the first coordinate
        x = np.array([[100 * k + j, 1] for j in range(4)], "<i2")
        rows.append((k, np.arange(4 * k, 4 * k + 4).astype("<i8").tobytes(), np.zeros(4, "<i8").tobytes(), x.tobytes(), x.min(axis=0).tobytes(), x.max(axis=0).tobytes()))
    tree = H.Tree(rows, 2, "<i2", True)
    q = np.array([1.0, 0.0])
    least, most = tree.intervals(q[None, :])
    best, looked = H.Best(3), []
    add = H.Best.add
    monkeypatch.setattr(H.Best, "add", lambda self, s, i, p: (looked.append(int(i[0])), add(self, s, i, p)))
    H._positives(tree, q, least[0], most[0], 0, (-1, 0), best)
    assert [r[:2] for r in best.rows] == [(703, 31), (702, 30), (701, 29)] and looked == [28]
    bests = [H.Best(2)]
    looked.clear()
    H._negatives(tree, q, least[0], most[0], 9, [(100, 202)], bests)  # only the leaves with scores in the window
    assert [r[:2] for r in bests[0].rows] == [(202, 10), (201, 9)] and looked == [8]


def test_unusable_rows_repeats_and_clashing_names(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=3).tolist(), i % 2) for i in range(40)] + [(None, [1.0, 1.0, 1.0], 1), (50, None, 0), (51, [1.0, None, 0.0], 0), (52, [1.0, 2.0], 1),
                                                                           (53, [float("nan"), 1.0, 1.0], 0), (54, [1.0, 1.0, 1.0], None), (55, [float("inf"), 0.0, 0.0], 1)]
    rows += rows[:12]  # repeated rows, anchors among them
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit("u")).withColumn("x", F.lit(1))
    as_float = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v], y) for i, v, y in rows]
    assert mined(spark, d, 4, leaf=5) == plain(as_float, lambda i: i % 4 == 0)


def test_enormous_components_are_exact(spark):
    rows = [(i, [1e12 * (i % 5 + 1), float(i), -3e9 * (i % 3)], i % 2) for i in range(30)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = [tuple(None if isinstance(c, int) and abs(c) >= 1 << 63 else c for c in r) for r in plain(rows, lambda i: i % 10 == 0)]
    assert mined(spark, d, 10, leaf=4) == sorted(want, key=str)


def test_empty_tables(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert mined(spark, spark.createDataFrame([], kind), 10) == []
    assert mined(spark, spark.createDataFrame([(1, [1.0, 2.0], 0)], kind), 10) == []  # no anchor
    assert mined(spark, spark.createDataFrame([(10, [1.0, 2.0], 0)], kind), 10) == []  # no other row
