"""Registered queries: composite pipelines and models (SURVEY P*, K*).

Model outputs depend on the trainer, so those carry a rows-only check; reports, the rule override
(K7), ordered target statistics and the precision of prefixes (K1) are deterministic and have SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from frauddeck.operators import curves, genetic, leafwise, ml, network, ordered, profile, split, star
from frauddeck.plans import pipelines as P
from frauddeck.plans.catalog import query
from frauddeck.plans.common import r, tx, views
from frauddeck.plans.q_metrics import AG_SQL
from frauddeck.plans.q_profile import RATE, STAR, _band_sql
from frauddeck.sources import adapter
from frauddeck.sources.io import written
from frauddeck.operators.attach import attach_row


NUM_FEATURES = ["TX_AMOUNT_log", "distance", "hour", "dayofweek", "time_since_last_tx", "cust_tx_count_cumm",
                "cust_avg_amount_cumm", "cust_std_amount_cumm", "amount_deviation", "cust_amount_mean_last_5",
                "amount_percentile_merchant", "mcc_frequency", "is_night", "cashback_ratio", "term_tx_velocity_1h"]


def _p3(spark, sf, fact="events"):
    v = views(spark, sf, fact)
    return P.p3_unified_features(v["transactions"], v["customers"], v["terminals"], v["merchants"])


def _staged(spark, sf, split_first=True):
    """Feature table computed once and written, so that fold / seed / parameter loops read the columns they need; with
    ``is_train`` (the earliest 80 %), by whose rows all that is fitted is fitted."""
    from frauddeck.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    v = views(spark, sf)
    d = P.time_split_features(*[v[x] for x in ("transactions", "customers", "terminals", "merchants")]) if split_first else _p3(spark, sf)
    cols = _features(d)  # the trainers take no NaN: what is missing is 0
    return written(d.select("TX_ID", "TX_TS", "TX_FRAUD", "is_fraudulent_terminal", *(["is_train"] if split_first else []), *cols).na.fill(0, cols))


def _features(d):
    """Every numeric column of P3 but ids, the label, split marks and the terminal flag, which is made of labels."""
    out = ("TX_ID", "CUSTOMER_ID", "MERCHANT_ID", "TERMINAL_ID", "TX_FRAUD", "is_fraudulent_terminal", "is_train", "fold")
    return [c for c, kind in d.dtypes if kind in ("int", "bigint", "double") and c not in out]


#: Smaller than the operators' defaults, for the run time of the registered queries (README): 15 leaves a
#: tree, at most 50 trees, stopped after 5 without a better average precision; ten epochs.
BOOSTING = leafwise.Settings(rounds=50, leaves=15, patience=5, every=5)
GENETIC = genetic.Settings(population=10, generations=4)
NETWORK = network.Settings(hidden=(256, 128, 64), norms=(True, True, False), dropout=(0.4, 0.3, 0.2), batch=1024, epochs=10)


def _p8(spark, sf):
    feats = _staged(spark, sf)
    return P.p8_train_score_submit(feats.filter("is_train = 1"), feats.filter("is_train = 0"), _features(feats), settings=BOOSTING)


@query("p8_k1_k5_k7_oof_gbt")
def p8_k1_k5_k7_oof_gbt(spark, sf):
    """OOF booster on the unified features (time split: first 80% train, rest test); returns OOF AUC/AP."""
    out = _p8(spark, sf)
    return attach_row(out["auc"](), out["ap"]()).select(r("roc_auc", 3).alias("roc_auc"),
                                                 r("average_precision", 3).alias("average_precision"))


@query("p8_submission")
def p8_submission(spark, sf):
    """The same run's submission: mean score of the five fold models, known-bad terminals overridden."""
    return _p8(spark, sf)["submission"].select("TX_ID", "TX_FRAUD")


@query("k1_k11_gbt_validation_scores")
def k1_k11_gbt_validation_scores(spark, sf):
    feats = _staged(spark, sf)
    valid = feats.filter("is_train = 0")
    m = ml.fit_gbt(ml.with_validation(feats.filter("is_train = 1"), valid), _features(feats), weight_col="_weight", validation_col="_valid")
    return ml.score(m, valid, threshold=0.5)


@query("k3_k10_tree_importance")
def k3_k10_tree_importance(spark, sf):
    feats = _staged(spark, sf)
    m = ml.fit_tree(feats.filter("is_train = 1"), _features(feats))
    return ml.feature_importance(m, _features(feats))


@query("k2_mlp_scores")
def k2_mlp_scores(spark, sf):
    feats = _staged(spark, sf)
    m = ml.fit_mlp(feats.filter("is_train = 1"), _features(feats), oversample=3)
    return ml.score(m, feats.filter("is_train = 0"))


@query("k2_network_scores")
def k2_network_scores(spark, sf):
    """K2: network with batch normalisation, dropout, weighted loss, mini-batches and patience."""
    feats = _staged(spark, sf)
    train, valid = feats.filter("is_train = 1"), feats.filter("is_train = 0")
    return network.score(network.fit(train, valid, _features(feats), settings=NETWORK), valid)


@query("k7_rule_override", """
WITH bad AS (SELECT TERMINAL_ID FROM tx GROUP BY TERMINAL_ID HAVING COUNT(*) >= 5 AND AVG(TX_FRAUD) >= 0.3)
SELECT TX_ID, ROUND(CASE WHEN b.TERMINAL_ID IS NOT NULL THEN GREATEST(s.TX_FRAUD, 0.95) ELSE s.TX_FRAUD END, 6) AS TX_FRAUD
FROM scores_a s JOIN tx USING (TX_ID) LEFT JOIN bad b USING (TERMINAL_ID)""")
def k7_rule_override(spark, sf):
    t = tx(spark, sf)
    bad = profile.compromised_entities(t, "TERMINAL_ID", min_count=5, threshold=0.3)
    flagged = star.membership_flag(adapter.scores_a(t).join(t.select("TX_ID", "TERMINAL_ID"), "TX_ID"), bad,
                                   "TERMINAL_ID", "is_bad")
    out = ml.override_known_bad(flagged, "is_bad")
    return out.select("TX_ID", r("TX_FRAUD").alias("TX_FRAUD"))


@query("k4_random_search_time_folds")
def k4_random_search_time_folds(spark, sf):
    """K4: seeded random parameter draws scored by mean AUC over expanding time folds."""
    feats = split.time_folds(_staged(spark, sf, split_first=False)).checkpoint(eager=True)
    return ml.search_time_folds(feats, _features(feats), params=ml.random_param_sets(10, seed=1)).select("param_id", r("mean_auc", 3).alias("mean_auc"))


@query("k6_seed_bagging")
def k6_seed_bagging(spark, sf):
    """K6: mean validation score of boosters trained with five seeds."""
    feats = _staged(spark, sf)
    valid = feats.filter("is_train = 0")
    return ml.seed_bagging(ml.with_validation(feats.filter("is_train = 1"), valid), valid, _features(feats),
                           weight_col="_weight", validation_col="_valid")


# ---------------------------------------------------------------- K1: categoricals, curves, leaf-wise trees

OTS_COLS = ["CARD_BRAND", "TRANSACTION_STATUS", "TERMINAL_ID", "MERCHANT_ID"]
OTS_ORDERS = ["((TX_ID * 7919 + 104729) % 1000003) / 1000003.0", "((TX_ID * 15485863 + 32452843) % 1000003) / 1000003.0"]


def _ots_sql():
    cols = ", ".join(f"""ROUND((COALESCE(SUM(TX_FRAUD) OVER w{i}_{p}, 0) + 0.5 * g) / (COUNT(TX_FRAUD) OVER w{i}_{p} + 0.5), 8) AS {c}_ts{p}"""
                     for i, c in enumerate(OTS_COLS) for p in range(len(OTS_ORDERS)))
    windows = ", ".join(f"w{i}_{p} AS (PARTITION BY {c} ORDER BY CAST({o} AS DOUBLE), TX_ID ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
                        for i, c in enumerate(OTS_COLS) for p, o in enumerate(OTS_ORDERS))
    return f"WITH g AS (SELECT AVG(CAST(TX_FRAUD AS DOUBLE)) AS g FROM tx) SELECT TX_ID, {cols} FROM tx, g WINDOW {windows}"


def _ots_orders():
    return [(F.col("TX_ID") * m + a) % 1000003 / F.lit(1000003.0) for m, a in ((7919, 104729), (15485863, 32452843))]


@query("k1_ordered_target_statistics", _ots_sql())
def k1_ordered_target_statistics(spark, sf):
    """K1: four categoricals as smoothed label means of earlier rows, in two permutations."""
    d = ordered.ordered_target_statistics(tx(spark, sf), OTS_COLS, orders=_ots_orders(), weight=0.5)
    return d.select("TX_ID", *[r(c, 8).alias(c) for c in d.columns if c != "TX_ID"])


@query("k1_ordered_target_statistics_hot", _ots_sql())
def k1_ordered_target_statistics_hot(spark, sf):
    """The same by buckets, as for categories that hold more rows than a task should."""
    d = ordered.ordered_target_statistics(tx(spark, sf), OTS_COLS, orders=_ots_orders(), weight=0.5, rows_per_bucket=400)
    return d.select("TX_ID", *[r(c, 8).alias(c) for c in d.columns if c != "TX_ID"])


@query("k1_target_statistics_of_new_rows", f"""
WITH tr AS (SELECT * FROM tx WHERE TX_ID % 5 <> 0), g AS (SELECT AVG(CAST(TX_FRAUD AS DOUBLE)) AS g FROM tr)
SELECT t.TX_ID, {', '.join(f"ROUND(COALESCE((s{i}.p + 0.5 * g) / (s{i}.n + 0.5), g), 8) AS {c}_ts" for i, c in enumerate(OTS_COLS))}
FROM tx t, g {' '.join(f"LEFT JOIN (SELECT {c} AS v, SUM(TX_FRAUD) AS p, COUNT(*) AS n FROM tr GROUP BY 1) s{i} ON t.{c} = s{i}.v" for i, c in enumerate(OTS_COLS))}
WHERE t.TX_ID % 5 = 0""")
def k1_target_statistics_of_new_rows(spark, sf):
    """K1's rule for rows to score: statistics of all training rows; categories unseen there get the prior."""
    t = tx(spark, sf)
    train, new = t.where("TX_ID % 5 <> 0"), t.where("TX_ID % 5 = 0")
    prior = train.agg(F.avg(F.col("TX_FRAUD").cast("double"))).first()[0] or 0.0
    d = ordered.apply_target_statistics(new, ordered.fit_target_statistics(train, OTS_COLS), OTS_COLS, prior, weight=0.5)
    return d.select("TX_ID", *[r(f"{c}_ts", 8).alias(f"{c}_ts") for c in OTS_COLS])


PREFIXES = 12


@query("k1_precision_of_prefixes", f"""
WITH m AS (SELECT t.TX_FRAUD AS y, i AS iteration, ROUND(a.TX_FRAUD, 3) + i * ROUND(b.TX_FRAUD, 2) AS m
  FROM tx t JOIN scores_a a USING (TX_ID) JOIN scores_b b USING (TX_ID), range({PREFIXES}) p(i)),
c AS (SELECT iteration, m, COUNT(*) AS n, SUM(y) AS pos FROM m GROUP BY 1, 2),
k AS (SELECT iteration, pos, SUM(n) OVER w AS cn, SUM(pos) OVER w AS cp, SUM(pos) OVER (PARTITION BY iteration) AS P FROM c
  WINDOW w AS (PARTITION BY iteration ORDER BY m DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT CAST(iteration AS INTEGER) AS iteration, ROUND(SUM(pos / P * cp / cn), 9) AS average_precision FROM k GROUP BY 1""")
def k1_precision_of_prefixes(spark, sf):
    """K1's learning curve over given margins: tie-correct average precision of twelve prefixes."""
    t = tx(spark, sf)
    j = (t.select("TX_ID", "TX_FRAUD").join(adapter.scores_a(t).select("TX_ID", F.round("TX_FRAUD", 3).alias("a")), "TX_ID")
         .join(adapter.scores_b(t).select("TX_ID", F.round("TX_FRAUD", 2).alias("b")), "TX_ID"))
    d = j.select("TX_FRAUD", F.array(*[F.col("a") + i * F.col("b") for i in range(PREFIXES)]).alias("margins"))
    return curves.ap_by_iteration(d).select("iteration", r("average_precision", 9).alias("average_precision"))


@query("k1_learning_curve")
def k1_learning_curve(spark, sf):
    """K1: average precision of every prefix of a boosted ensemble on learning and held-out rows, with
    the iteration that early stopping keeps."""
    feats = _staged(spark, sf)
    rows, cols = ml.with_validation(feats.filter("is_train = 1"), feats.filter("is_train = 0")), _features(feats)
    m = ml.fit_gbt(rows.filter("not _valid"), cols, weight_col="_weight", max_iter=30)
    margins = written(curves.running_margins(m, rows).select("_valid", "TX_FRAUD", "margins"))  # each part is read twice
    learn = curves.ap_by_iteration(margins.filter("not _valid")).withColumnRenamed("average_precision", "learn_ap")
    test = curves.ap_by_iteration(margins.filter("_valid")).withColumnRenamed("average_precision", "test_ap").checkpoint()
    best, _ = curves.best_iteration(sorted((x["iteration"], x["test_ap"]) for x in test.collect()), 150)  # one row for each iteration
    return learn.join(test, "iteration").select("iteration", r("learn_ap", 4).alias("learn_ap"), r("test_ap", 4).alias("test_ap"), (F.col("iteration") == best).alias("is_best"))


@query("k1_leafwise_scores")
def k1_leafwise_scores(spark, sf):
    """K1: leaf-wise booster with row and column sampling, stopped by the held-out rows' average precision."""
    feats = _staged(spark, sf)
    m = leafwise.fit(feats.withColumn("_valid", F.col("is_train") == 0), _features(feats), valid="_valid", settings=BOOSTING)
    return leafwise.score(m, feats.filter("is_train = 0"))


# ---------------------------------------------------------------- reports, one query each

def _p6(spark, sf):
    v = views(spark, sf)
    return P.p6_profiling_pack(star.star_join(v["transactions"], v["customers"], v["terminals"], v["merchants"]))


def _p9(spark, sf):
    t = tx(spark, sf)
    return P.p9_blend_and_compare(adapter.scores_a(t), adapter.scores_b(t))


def _p10(spark, sf):
    v = views(spark, sf, "lineitem")
    return P.p10_spatial_risk(v["transactions"], v["customers"], v["terminals"])


def _p11(spark, sf):
    t = tx(spark, sf)
    return P.p11_score_report(adapter.scores_a(t).join(t.select("TX_ID", "TX_TS", "TRANSACTION_TYPE", "CARD_BRAND"), "TX_ID"))


def _rounded(d, digits=6):
    """Doubles rounded, other columns as they are."""
    return d.select(*[r(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in d.dtypes])


def _report(name, frame, report, sql=None, post=lambda d: d, digits=6):
    query(name, sql)(lambda spark, sf: _rounded(post(frame(spark, sf)[report]()), digits))


def _rates(key, src=STAR, tail=""):
    return f"SELECT {key}, {RATE} FROM {src} GROUP BY 1 {tail}"


def _top(col, least):
    return (f"SELECT {col}, {RATE} FROM {STAR} WHERE {col} IS NOT NULL GROUP BY 1 HAVING COUNT(*) >= {least} ORDER BY AVG(TX_FRAUD) DESC, {col} LIMIT 20")


def _histogram(col, src, bins, by=None):
    keys, on = (f"{by}, ", f"USING ({by})") if by else ("", "ON true")
    return f"""
WITH v AS (SELECT {keys}{col} AS x FROM {src}), rng AS (SELECT min(x) AS lo, max(x) AS hi FROM v),
b AS (SELECT {keys}CAST(LEAST(floor((x - lo) / ((hi - lo) / {bins})), {bins - 1}) AS BIGINT) AS bin, lo, hi FROM v, rng),
tot AS (SELECT {keys}COUNT(*) AS n_all FROM v {f'GROUP BY {by}' if by else ''})
SELECT {keys}bin, ROUND(lo + bin * (hi - lo) / {bins}, 6) AS bin_left, ROUND(lo + (bin + 1) * (hi - lo) / {bins}, 6) AS bin_right,
  COUNT(*) AS n, ROUND(COUNT(*) / (n_all * (hi - lo) / {bins}), 6) AS density FROM b JOIN tot {on} GROUP BY {keys}bin, lo, hi, n_all"""


def _as_long(col):
    return lambda d: d.withColumn(col, F.col(col).cast("bigint"))


_report("p6_overall", _p6, "overall", f"SELECT {RATE} FROM {STAR}")
_report("p6_by_hour", _p6, "by_hour", _rates("CAST(hour(TX_TS) AS BIGINT) AS hour"), _as_long("hour"))
_report("p6_by_weekday", _p6, "by_weekday", _rates("CAST(isodow(TX_TS) - 1 AS BIGINT) AS weekday"), _as_long("weekday"))
_report("p6_by_brand", _p6, "by_brand", _rates("CARD_BRAND"))
_report("p6_by_mcc_top20", _p6, "by_mcc_top20", _top("MCC_CODE", 100))
_report("p6_by_terminal_top20", _p6, "by_terminal_top20", _top("TERMINAL_ID", 50))
_report("p6_amount_bands", _p6, "amount_bands", _band_sql("TX_AMOUNT", profile.AMOUNT_EDGES, profile.AMOUNT_LABELS, "amount_bin", STAR))
_report("p6_amount_buckets", _p6, "amount_buckets", """
WITH b AS (SELECT CAST(ceil(TX_AMOUNT / 10) - 1 AS BIGINT) AS bucket, TX_FRAUD FROM tx WHERE TX_AMOUNT > 0 AND TX_AMOUNT <= 800)
SELECT '$' || CAST(bucket * 10 AS VARCHAR) || '-' || CAST(bucket * 10 + 9 AS VARCHAR) AS amount_bucket, bucket, COUNT(*) AS n_tx,
  CAST(SUM(TX_FRAUD) AS BIGINT) AS n_fraud, ROUND(SUM(TX_FRAUD) / (SELECT SUM(TX_FRAUD) FROM b) * 100, 6) AS fraud_contribution FROM b GROUP BY bucket""")
_report("p6_histogram", _p6, "histogram", _histogram("TX_AMOUNT", STAR, 50, "TX_FRAUD"))
_report("p6_profiling_pack_summary", _p6, "summary", f"""
SELECT COUNT(*) AS n_tx, CAST(SUM(TX_FRAUD) AS BIGINT) AS n_fraud, ROUND(AVG(TX_FRAUD), 6) AS fraud_rate, ROUND(AVG(TX_AMOUNT), 6) AS mean_amount,
  ROUND(quantile_cont(TX_AMOUNT, 0.5), 6) AS median_amount, ROUND(AVG(CASE WHEN TX_FRAUD = 1 THEN TX_AMOUNT END), 6) AS mean_fraud_amount,
  ROUND(AVG(CASE WHEN TX_FRAUD = 0 THEN TX_AMOUNT END), 6) AS mean_legit_amount, COUNT(DISTINCT CUSTOMER_ID) AS n_customers,
  COUNT(DISTINCT TERMINAL_ID) AS n_terminals, COUNT(DISTINCT MERCHANT_ID) AS n_merchants FROM {STAR}""", lambda d: d.drop("first_ts", "last_ts"))

BLENDED = "WITH j AS (SELECT TX_ID, LEAST(GREATEST(a.TX_FRAUD, 1e-8), 1 - 1e-8) AS p, LEAST(GREATEST(b.TX_FRAUD, 1e-8), 1 - 1e-8) AS q FROM scores_a a JOIN scores_b b USING (TX_ID))"
_report("p9_blends", _p9, "blends", BLENDED + """
SELECT TX_ID, ROUND(0.6 * p + 0.4 * q, 6) AS weighted, ROUND(p ** 0.62 * q ** 0.38, 6) AS geometric FROM j""", lambda d: d.select("TX_ID", "weighted", "geometric"))
_report("p9_blend_and_compare", _p9, "grades", AG_SQL + """
SELECT n AS common_transactions, ROUND(bin_ag, 6) AS binary_agreement_percentage, ROUND(ex_ag, 6) AS exact_agreement_percentage,
  ROUND(r, 6) AS correlation, ROUND(mae, 6) AS mean_absolute_error, ROUND(rmse, 6) AS root_mean_squared_error,
  CAST(tn AS BIGINT) AS true_negatives, CAST(fp AS BIGINT) AS false_positives, CAST(fn AS BIGINT) AS false_negatives, CAST(tp AS BIGINT) AS true_positives,
  ROUND(m1, 6) AS file1_mean, ROUND(m2, 6) AS file2_mean, ROUND(s1, 6) AS file1_std, ROUND(s2, 6) AS file2_std,
  ROUND(dm, 6) AS probability_difference_mean, ROUND(ds, 6) AS probability_difference_std, ROUND(kappa, 6) AS cohen_kappa,
  CASE WHEN bin_ag >= 95 THEN 'Excellent' WHEN bin_ag >= 85 THEN 'Good' WHEN bin_ag >= 70 THEN 'Moderate' ELSE 'Poor' END AS agreement_level,
  CASE WHEN kappa >= 0.81 THEN 'Almost Perfect' WHEN kappa >= 0.61 THEN 'Substantial' WHEN kappa >= 0.41 THEN 'Moderate' WHEN kappa >= 0.21 THEN 'Fair' ELSE 'Slight' END AS kappa_level,
  CASE WHEN abs(r) >= 0.7 THEN 'Strong' WHEN abs(r) >= 0.5 THEN 'Moderate' ELSE 'Weak' END AS correlation_strength FROM kk""")

CELL = "COUNT(*) AS n_tx, ROUND(AVG(TX_FRAUD), 6) AS fraud_rate, ROUND(ln(1 + AVG(TX_FRAUD)), 6) AS log_fraud_rate"
_report("p10_customer_cells", _p10, "customer_cells", f"""
SELECT round(x_customer_id) AS cx, round(y_customer_id) AS cy, {CELL} FROM ltx JOIN customers USING (CUSTOMER_ID)
WHERE x_customer_id IS NOT NULL AND y_customer_id IS NOT NULL GROUP BY 1, 2 HAVING COUNT(*) >= 3""")
_report("p10_terminal_cells", _p10, "terminal_cells", f"""
WITH bad AS (SELECT TERMINAL_ID FROM ltx GROUP BY 1 HAVING COUNT(*) >= 5 AND AVG(TX_FRAUD) >= 1.0)
SELECT round(x_terminal_id) AS tx_, round(y_terminal_id) AS ty, {CELL} FROM ltx JOIN terminals USING (TERMINAL_ID)
WHERE x_terminal_id IS NOT NULL AND y_terminal_id IS NOT NULL AND TERMINAL_ID NOT IN (SELECT TERMINAL_ID FROM bad) GROUP BY 1, 2 HAVING COUNT(*) >= 3""")
_report("p10_rows", _p10, "rows", None, lambda d: d.select("TX_ID", "customer_area_risk", "terminal_area_risk", "combined_area_risk"))
_report("p10_k8_k9_spatial_risk_grid", _p10, "grid", None, lambda d: d.select("gx", "gy", "risk"))

SCORED = "(SELECT s.TX_ID, s.TX_FRAUD, TX_TS, TRANSACTION_TYPE, CARD_BRAND, CAST(s.TX_FRAUD >= 0.5 AS INTEGER) AS pred FROM scores_a s JOIN tx USING (TX_ID))"
MEAN = "ROUND(AVG(TX_FRAUD), 6) AS mean_score, COUNT(*) AS n"
_report("p11_histogram", _p11, "histogram", _histogram("TX_FRAUD", SCORED, 30))
_report("p11_describe", _p11, "describe", f"""
SELECT COUNT(TX_FRAUD) AS count, ROUND(AVG(TX_FRAUD), 6) AS mean, ROUND(stddev_samp(TX_FRAUD), 6) AS std, ROUND(MIN(TX_FRAUD), 6) AS min,
  ROUND(MAX(TX_FRAUD), 6) AS max, ROUND(quantile_cont(TX_FRAUD, 0.25), 6) AS p25, ROUND(quantile_cont(TX_FRAUD, 0.5), 6) AS p50,
  ROUND(quantile_cont(TX_FRAUD, 0.75), 6) AS p75 FROM {SCORED}""")
_report("p11_top5pct", _p11, "top5pct", f"""
WITH s AS (SELECT * FROM {SCORED}), c AS (SELECT quantile_cont(TX_FRAUD, 0.95) AS cut FROM s)
SELECT TX_ID, ROUND(TX_FRAUD, 6) AS TX_FRAUD, TRANSACTION_TYPE, CARD_BRAND, pred, ROUND(cut, 6) AS is_top_pct_cutoff, CAST(TX_FRAUD > cut AS INTEGER) AS is_top_pct FROM s, c""",
        lambda d: d.drop("TX_TS"))
_report("p11_by_hour", _p11, "by_hour", f"SELECT CAST(hour(TX_TS) AS BIGINT) AS hour, {MEAN} FROM {SCORED} GROUP BY 1", _as_long("hour"))
_report("p11_by_type", _p11, "by_type", f"SELECT TRANSACTION_TYPE, {MEAN} FROM {SCORED} GROUP BY 1")
_report("p11_by_brand", _p11, "by_brand", f"SELECT CARD_BRAND, {MEAN} FROM {SCORED} GROUP BY 1")
_report("p11_summary", _p11, "summary", f"""
SELECT COUNT(*) AS n_total, CAST(SUM(1 - pred) AS BIGINT) AS n_neg, CAST(SUM(pred) AS BIGINT) AS n_pos, ROUND(AVG(pred) * 100, 6) AS pos_rate_pct FROM {SCORED}""")
_report("p11_moments", _p11, "moments", f"SELECT ROUND(AVG(TX_FRAUD), 6) AS mean, ROUND(MAX(TX_FRAUD), 6) AS max, ROUND(stddev_samp(TX_FRAUD), 6) AS std FROM {SCORED}")
_report("p11_score_report_top10", _p11, "top10", f"""
SELECT TX_ID, ROUND(score, 6) AS TX_FRAUD, TRANSACTION_TYPE, CARD_BRAND, pred FROM (SELECT *, TX_FRAUD AS score FROM {SCORED}) ORDER BY score DESC, TX_ID LIMIT 10""", lambda d: d.drop("TX_TS"))


@query("k4_genetic_search")
def k4_genetic_search(spark, sf):
    """K4: genetic search of a tree's depth, least rows and impurity by held-out AUC; a row for each generation."""
    feats = _staged(spark, sf)
    fitness = genetic.tree_fitness(feats.filter("is_train = 1").cache(), feats.filter("is_train = 0").cache(), _features(feats))
    rows = genetic.evolve(fitness, genetic.TREE_BOUNDS, GENETIC, genetic.same_tree)
    return spark.createDataFrame([(x["generation"], x["evaluated"], *x["best"], x["best_fitness"], x["mean_fitness"]) for x in rows],
                                 "generation int, evaluated int, max_depth int, min_split int, min_leaf int, impurity int, best_auc double, mean_auc double")
