"""Ordered target statistics, learning curves, leaf-wise trees against plain Python, resumed folds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from frauddeck.operators import curves, leafwise, metrics, ml, ordered
from frauddeck.sources import io


def _cats(n=600):
    rnd = random.Random(5)
    # one category holds two thirds of the rows; some are null, some labels are missing
    return [(i, "HOT" if i % 3 else rnd.choice(["a", "b", None]), rnd.choice(["x", "y"]), None if i % 41 == 0 else int(rnd.random() < 0.3)) for i in range(n)]


@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 50])
def test_ordered_statistics_match_a_plain_loop(spark, rows_per_bucket):
    rows = _cats()
    df = spark.createDataFrame(rows, "TX_ID long, c string, f string, TX_FRAUD int").repartition(3)
    order = [F.col("TX_ID") * 7919 % 1009 / F.lit(1009.0), F.col("TX_ID") * 15013 % 100 / F.lit(100.0)]  # the second has ties
    places = [lambda i: (i * 7919 % 1009 / 1009.0, i), lambda i: (i * 15013 % 100 / 100.0, i)]
    out = ordered.ordered_target_statistics(df, ["c", "f"], orders=order, weight=2.0, rows_per_bucket=rows_per_bucket).collect()
    known = [y for *_, y in rows if y is not None]
    prior = sum(known) / len(known)
    got = {r["TX_ID"]: r for r in out}
    assert len(out) == len(rows)
    for p, place in enumerate(places):
        for col, name in ((1, "c"), (2, "f")):
            seen = {}
            for r in sorted(rows, key=lambda r: place(r[0])):
                s, n = seen.get(r[col], (0, 0))
                assert got[r[0]][f"{name}_ts{p}"] == pytest.approx((s + 2 * prior) / (n + 2), rel=1e-12)
                if r[3] is not None:
                    seen[r[col]] = (s + r[3], n + 1)


def test_own_label_never_counts(spark):
    """Turning one row's label leaves its own statistics as they are."""
    rows = _cats(90)
    turned = [(i, c, f, 1 - y if i == 7 else y) for i, c, f, y in rows]
    a, b = (ordered.ordered_target_statistics(spark.createDataFrame(x, "TX_ID long, c string, f string, TX_FRAUD int"), ["c", "f"], prior=0.3).where("TX_ID = 7").collect()[0] for x in (rows, turned))
    assert a == b


def test_statistics_of_new_rows(spark):
    train = spark.createDataFrame([(1, "a", 1), (2, "a", 0), (3, None, 1), (4, "b", None)], "TX_ID long, c string, TX_FRAUD int")
    new = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "zz")], "TX_ID long, c string")
    out = ordered.apply_target_statistics(new, ordered.fit_target_statistics(train, ["c"]), ["c"], 0.25, weight=1.0)
    assert dict(out.select("TX_ID", "c_ts").collect()) == {1: 1.25 / 3, 2: 0.25, 3: 1.25 / 2, 4: 0.25}


def _numbers(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(2)
    y = ((x[:, 0] + 0.5 * x[:, 1] ** 2 + rng.normal(size=n) * 0.5) > 0.8).astype(int)
    rows = [(i, *(None if i % 29 == j else float(v) for j, v in enumerate(r)), int(c)) for i, (r, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "TX_ID long, a double, b double, c double, TX_FRAUD int").repartition(4)


def test_curve_equals_scoring_truncated_models(spark):
    d = _numbers(spark).na.fill(0.0)
    model = ml.fit_gbt(d, ["a", "b", "c"], max_iter=6, max_depth=3)
    margins = curves.running_margins(model, d)
    curve = {r["iteration"]: r["average_precision"] for r in curves.ap_by_iteration(margins).collect()}
    assert sorted(curve) == list(range(6))
    last = ml.score(model, d, out="p").join(d.select("TX_ID", F.col("TX_FRAUD").alias("y")), "TX_ID")
    assert curve[5] == pytest.approx(metrics.average_precision(last).first()[0], rel=1e-9)
    gbt = model.stages[-1]
    vectors = model.stages[0].transform(d)
    for rounds in (1, 3):
        total = sum(w * F.col(f"p{i}") for i, w in enumerate(gbt.treeWeights[:rounds]))
        s = vectors
        for i in range(rounds):
            s = gbt.trees[i].transform(s.drop("prediction")).withColumnRenamed("prediction", f"p{i}")
        s = s.select(total.alias("p"), F.col("TX_FRAUD").alias("y"))
        assert curve[rounds - 1] == pytest.approx(metrics.average_precision(s).first()[0], rel=1e-9)
        p = margins.select("TX_ID", curves.margin_score("margins", 6).alias("p")).join(ml.score(model, d, out="q"), "TX_ID")
        assert p.agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0] < 1e-12


def test_curve_of_ties_and_no_positives(spark):
    d = spark.createDataFrame([(1, [0.5, 0.1]), (0, [0.5, 0.9]), (0, [0.2, 0.1])], "TX_FRAUD int, margins array<double>")
    assert dict(curves.ap_by_iteration(d).collect()) == {0: 0.5, 1: pytest.approx(1 / 3)}
    assert [r[1] for r in curves.ap_by_iteration(d.where("TX_FRAUD = 0")).collect()] == [None, None]
    assert curves.best_iteration([(0, 0.2), (1, 0.5), (2, 0.5), (3, 0.4)], 2) == (1, True)
    assert curves.best_iteration([(0, 0.2), (1, 0.5), (2, 0.5)], 2) == (1, False) and curves.best_iteration([(0, None)], 3) == (0, False)


def _plain_boosting(rows, features, s, rounds):
    """Best-first boosting, leaf by leaf, each leaf's sums taken from its own rows."""
    x, y, w, key, cuts, base = rows
    ranges, margin, trees = leafwise.ranges_of(x, cuts), np.full(len(y), base), []
    rng = random.Random(s.seed)
    for t in range(rounds):
        chosen = sorted(rng.sample(range(len(features)), max(1, round(s.columns * len(features)))))
        use = leafwise.drawn(key, s.seed + t // s.resample, s.rows)
        g, h = leafwise.gradients(margin, y, w)
        tree, at = leafwise.Tree(), np.zeros(len(y), np.int64)

        def sums(node):
            out = np.zeros((len(chosen), 3, leafwise.RANGES), np.int64)
            for r in np.flatnonzero(use & (at == node)):
                for i, f in enumerate(chosen):
                    out[i, :, ranges[r, f]] += (g[r], h[r], 1)
            return out
        open_leaves = {0: sums(0)}
        while len(open_leaves) < s.leaves:
            found = [(-b[0], n, b) for n, v in open_leaves.items() if (b := leafwise.best_split(v, s))]
            if not found:
                break
            _, node, (_, f, c, _) = min(found)
            left, right = tree.split(node, chosen[f], c)
            here = at == node
            at[here] = np.where(ranges[here, chosen[f]] > c, right, left)
            del open_leaves[node]
            open_leaves |= {left: sums(left), right: sums(right)}
        for node, v in open_leaves.items():
            tree.value[node] = leafwise.leaf_value(v, s)
        margin = margin + np.array(tree.value)[at]
        trees.append(tree)
    return trees


@pytest.mark.parametrize("ahead", [1, 32])
def test_leafwise_trees_equal_plain_ones(spark, ahead):
    d = _numbers(spark)
    s = leafwise.Settings(rounds=4, leaves=9, least_rows=6, every=3, ahead=ahead, columns=0.67, resample=2)
    model = leafwise.fit(d, ["a", "b", "c"], settings=s)
    rows = d.select("a", "b", "c", "TX_FRAUD", F.xxhash64("TX_ID").alias("k")).collect()
    x = np.array([[np.nan if r[c] is None else r[c] for c in "abc"] for r in rows])
    y = np.array([r["TX_FRAUD"] for r in rows], float)
    w = np.where(y == 1, (len(y) - y.sum()) / y.sum(), 1.0)
    plain = _plain_boosting((x, y, w, np.array([r["k"] for r in rows]), model.cuts, model.base), "abc", s, 4)
    assert len(model.trees) == 4 and any(len(t.feature) == 17 for t in plain)
    for a, b in zip(model.trees, plain):
        assert (a.feature, a.cut, a.left) == (b.feature, b.cut, b.left) and a.value == pytest.approx(b.value, rel=1e-12)


def test_leafwise_stops_early_scores_and_survives_json(spark):
    d = _numbers(spark, 600).withColumn("_v", F.col("TX_ID") % 4 == 0)
    s = leafwise.Settings(rounds=60, leaves=7, least_rows=5, patience=6, every=3)
    model = leafwise.fit(d, ["a", "b", "c"], valid="_v", settings=s)
    assert len(model.trees) < 60 and model.best == max(model.curve, key=lambda p: (p[1], -p[0]))[0] + 1
    again = leafwise.Model.from_json(model.to_json())
    a, b = (dict(leafwise.score(m, d.where("_v")).collect()) for m in (model, again))
    assert a == b and len(a) == 150
    held = d.where("_v").select("TX_ID", F.col("TX_FRAUD").alias("y"))
    for rounds in (1, model.best):
        p = leafwise.score(model, d.where("_v"), out="p", rounds=rounds).join(held, "TX_ID")
        assert metrics.average_precision(p).first()[0] == pytest.approx(dict(model.curve)[rounds - 1], rel=1e-9)
    auc = metrics.roc_auc(leafwise.score(model, d.where("_v"), out="p").join(held, "TX_ID")).first()[0]
    assert auc > 0.85


def test_leafwise_without_rows_or_one_class(spark):
    d = _numbers(spark, 40)
    for part, p in ((d.where("false"), 0.5), (d.where("TX_FRAUD = 0"), 0.0), (d.where("TX_FRAUD = 1"), 1.0)):
        m = leafwise.fit(part, ["a", "b", "c"])
        assert m.trees == [] and all(abs(v - p) < 1e-6 for _, v in leafwise.score(m, d).collect())


def test_folds_resume_where_a_run_died(spark, tmp_path):
    d = _numbers(spark, 200).withColumn("fold", (F.col("TX_ID") % 5).cast("int"))
    progress = io.FoldProgress(spark, str(tmp_path / "folds"))
    fitted = []

    def fit(train, held, fail=None):
        f = held.select("fold").first()[0]
        if f == fail:
            raise RuntimeError("lost")
        fitted.append(f)
        return leafwise.fit(train, ["a", "b", "c"], settings=leafwise.Settings(rounds=2, leaves=3, every=2))
    with pytest.raises(RuntimeError):
        ml.kfold_oof(d, d, ["a", "b", "c"], fit=lambda t, h: fit(t, h, 3), progress=progress)
    assert fitted == [0, 1, 2] and progress.done(5) == 3
    oof, test = ml.kfold_oof(d, d, ["a", "b", "c"], fit=fit, progress=progress)
    assert fitted == [0, 1, 2, 3, 4] and progress.done(5) == 5
    assert oof.count() == 200 == oof.select("TX_ID").distinct().count() and test.count() == 200
    plain, whole = ml.kfold_oof(d, d, ["a", "b", "c"], fit=fit)
    assert dict(plain.collect()) == dict(oof.collect()) and dict(whole.collect()) == dict(test.collect())


def test_cuts_of_many_rows_are_within_a_thousandth(spark, monkeypatch):
    """Summaries that are condensed and merged tell quantiles to a thousandth of the rows; missing values don't count."""
    rng = np.random.default_rng(8)
    n = 30_000
    x = np.stack([rng.normal(size=n), rng.integers(0, 3, n) * 1.0, np.exp(rng.normal(size=n) * 3)], axis=1)
    d = spark.createDataFrame([(*map(float, r), None if i % 3 else float("nan")) for i, r in enumerate(x)], "a double, b double, c double, d double").repartition(3)
    for name, value in (("FEW", 100), ("POINTS", 2048), ("CHUNK", 3000)):
        monkeypatch.setattr(leafwise, name, value)
    monkeypatch.setattr(type(d), "approxQuantile", None)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        cuts = leafwise._cuts(d, list("abcd"), n)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert cuts[1].tolist() == [0.0, 1.0, 2.0] and len(cuts[3]) == 0
    for f in (0, 2):
        rank = np.searchsorted(np.sort(x[:, f]), cuts[f], side="right") / n
        assert len(cuts[f]) == 254 and np.abs(rank - np.arange(1, 255) / 255).max() < 1e-3


def test_trial_splits_that_no_tree_needs_are_not_counted(spark, monkeypatch):
    """Fewer nodes are counted than with every leaf tried, for the same tree; a round is one Spark job."""
    d, rounds = _numbers(spark), []
    s = leafwise.Settings(rounds=1, leaves=4, least_rows=4, ahead=32)
    real = leafwise._count

    def counted(*a):
        count = real(*a)
        return lambda tree, nodes: rounds.append(len(nodes)) or count(tree, nodes)
    monkeypatch.setattr(leafwise, "_count", counted)
    group = "booster-jobs"
    jobs = []
    real_added = leafwise._added

    def added(parts):
        spark.sparkContext.setJobGroup(group, "")
        out = real_added(parts)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return out
    monkeypatch.setattr(leafwise, "_added", added)
    model = leafwise.fit(d, ["a", "b", "c"], settings=s)
    assert sum(f < 0 for f in model.trees[0].feature) == 4 and jobs[-1] == len(rounds)
    assert max(rounds) <= 3  # a tree of four leaves has three splits


def test_seeds_are_fitted_at_the_same_time_and_meet_in_their_order(monkeypatch):
    import threading
    meet, seen = threading.Barrier(3, timeout=20), []
    monkeypatch.setattr(ml, "fit_gbt", lambda *a, seed, **k: (meet.wait(), f"model {seed}")[1])
    monkeypatch.setattr(ml, "_mean_of_models", lambda models, *a: seen.extend(models))
    ml.seed_bagging(None, None, ["x"], seeds=(4, 5, 6))
    assert seen == ["model 4", "model 5", "model 6"]
