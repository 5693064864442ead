"""Registered queries: metrics, score comparison, blends and calibration (SURVEY L*, M*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from frauddeck.operators import blend as M, metrics as L
from frauddeck.operators.star import align_scores, labels_and_scores
from frauddeck.plans.catalog import query
from frauddeck.plans.common import r, tx
from frauddeck.sources import adapter

LS = "ls AS (SELECT t.TX_ID, t.TX_FRAUD AS y, a.TX_FRAUD AS p_a, b.TX_FRAUD AS p_b FROM tx t JOIN scores_a a USING (TX_ID) JOIN scores_b b USING (TX_ID))"


def _ls(spark, sf):
    t = tx(spark, sf)
    return labels_and_scores(t, adapter.scores_a(t), adapter.scores_b(t))


def _ls_tied(spark, sf):
    """Scores rounded to 2 decimals: many ties, to exercise the tie rules."""
    return _ls(spark, sf).withColumn("p_a", F.round("p_a", 2)).withColumn("p_b", F.round("p_b", 2))


@query("l1_confusion_matrix", f"""WITH {LS}
SELECT CAST(SUM(CASE WHEN y = 0 AND p_a < 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
  CAST(SUM(CASE WHEN y = 0 AND p_a >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(SUM(CASE WHEN y = 1 AND p_a < 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
  CAST(SUM(CASE WHEN y = 1 AND p_a >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS tp FROM ls""")
def l1_confusion_matrix(spark, sf):
    d = _ls(spark, sf).withColumn("pred", (F.col("p_a") >= 0.5).cast("int"))
    return L.confusion(d, "y", "pred")


CR_SQL = f"""WITH {LS}, d AS (SELECT y, CAST(p_a >= 0.5 AS INTEGER) AS pred FROM ls),
cls AS (SELECT DISTINCT y AS c FROM d UNION SELECT DISTINCT pred FROM d),
per AS (SELECT c, SUM(CASE WHEN y = c AND pred = c THEN 1 ELSE 0 END) AS tp, SUM(CASE WHEN pred = c THEN 1 ELSE 0 END) AS pn,
          SUM(CASE WHEN y = c THEN 1 ELSE 0 END) AS sup FROM cls, d GROUP BY c),
m AS (SELECT c, CASE WHEN pn > 0 THEN tp / pn ELSE 0 END AS pr, CASE WHEN sup > 0 THEN tp / sup ELSE 0 END AS re, sup FROM per),
f AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1 FROM m)"""


@query("l4_class_report", CR_SQL + """
SELECT c AS class, ROUND(pr, 6) AS precision, ROUND(re, 6) AS recall, ROUND(f1, 6) AS f1, CAST(sup AS BIGINT) AS support FROM f""")
def l4_class_report(spark, sf):
    d = _ls(spark, sf).withColumn("pred", (F.col("p_a") >= 0.5).cast("int"))
    rep = L.class_report(d, "y", "pred")
    return rep.select("class", *[r(c).alias(c) for c in ["precision", "recall", "f1"]], "support")


@query("l2_l3_summary_metrics", CR_SQL + """
SELECT ROUND((SELECT AVG(CAST(y = pred AS DOUBLE)) FROM d), 6) AS accuracy,
  ROUND(SUM(pr * sup) / SUM(sup), 6) AS precision_weighted, ROUND(SUM(re * sup) / SUM(sup), 6) AS recall_weighted,
  ROUND(SUM(f1 * sup) / SUM(sup), 6) AS f1_weighted, ROUND(AVG(f1), 6) AS f1_macro,
  ROUND(COALESCE(MAX(CASE WHEN c = 1 THEN pr END), 0), 6) AS precision_pos,
  ROUND(COALESCE(MAX(CASE WHEN c = 1 THEN re END), 0), 6) AS recall_pos,
  ROUND(COALESCE(MAX(CASE WHEN c = 1 THEN f1 END), 0), 6) AS f1_pos FROM f""")
def l2_l3_summary_metrics(spark, sf):
    d = _ls(spark, sf).withColumn("pred", (F.col("p_a") >= 0.5).cast("int"))
    s = L.summary_metrics(d, "y", "pred")
    return s.select(*[r(c).alias(c) for c in s.columns])


def _g_sql(col: str, tied: bool, desc: bool) -> str:
    p = f"ROUND({col}, 2)" if tied else col
    order = "DESC" if desc else ""
    return f"""WITH {LS}, g AS (SELECT {p} AS s, SUM(CAST(y AS DOUBLE)) AS pos, SUM(1 - CAST(y AS DOUBLE)) AS neg FROM ls GROUP BY 1),
c AS (SELECT *, SUM(pos) OVER (ORDER BY s {order} ROWS UNBOUNDED PRECEDING) AS ctp,
      SUM(neg) OVER (ORDER BY s {order} ROWS UNBOUNDED PRECEDING) AS cfp,
      (SELECT SUM(pos) FROM g) AS P, (SELECT SUM(neg) FROM g) AS N FROM g)"""


def _auc_sql(col, tied):
    return _g_sql(col, tied, False) + """
SELECT ROUND(CASE WHEN MAX(P) > 0 AND MAX(N) > 0 THEN SUM(pos * (cfp - neg + neg / 2)) / (MAX(P) * MAX(N)) ELSE 0.5 END, 9) AS roc_auc FROM c"""


@query("l5_l6_roc_auc", _auc_sql("p_a", False))
def l5_l6_roc_auc(spark, sf):
    return L.roc_auc(_ls(spark, sf), "p_a", "y").select(r("roc_auc", 9).alias("roc_auc"))


@query("l5_l6_roc_auc_ties", _auc_sql("p_b", True))
def l5_l6_roc_auc_ties(spark, sf):
    return L.roc_auc(_ls_tied(spark, sf), "p_b", "y").select(r("roc_auc", 9).alias("roc_auc"))


def _ap_sql(col, tied):
    return _g_sql(col, tied, True) + """
SELECT ROUND(SUM(pos / P * ctp / (ctp + cfp)), 9) AS average_precision FROM c"""


@query("l7_average_precision", _ap_sql("p_a", False))
def l7_average_precision(spark, sf):
    return L.average_precision(_ls(spark, sf), "p_a", "y").select(r("average_precision", 9).alias("average_precision"))


@query("l7_average_precision_ties", _ap_sql("p_b", True))
def l7_average_precision_ties(spark, sf):
    return L.average_precision(_ls_tied(spark, sf), "p_b", "y").select(
        r("average_precision", 9).alias("average_precision"))


PTS_SQL = """, pts AS (SELECT s AS threshold, ctp AS tp, cfp AS fp, P, N,
  CASE WHEN ctp + cfp > 0 THEN ctp / (ctp + cfp) ELSE 0 END AS precision, ctp / P AS recall, cfp / N AS fpr,
  CASE WHEN ctp - pos + cfp - neg = 0 THEN 1.0 ELSE (ctp - pos) / (ctp - pos + cfp - neg) END AS prev_precision,
  (ctp - pos) / P AS prev_recall, ctp - pos < P AS before_full_recall FROM c)"""


@query("l8_pr_auc_trapezoid_ties", _g_sql("p_b", True, True) + PTS_SQL + """
SELECT ROUND(COALESCE(SUM((recall - prev_recall) * (precision + prev_precision) / 2), 0), 9) AS pr_auc
FROM pts WHERE before_full_recall""")
def l8_pr_auc_trapezoid_ties(spark, sf):
    return L.pr_auc_trapezoid(_ls_tied(spark, sf), "p_b", "y").select(r("pr_auc", 9).alias("pr_auc"))


@query("l9_pr_roc_curve_points", _g_sql("p_a", True, True) + PTS_SQL + """
SELECT ROUND(threshold, 6) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, ROUND(precision, 9) AS precision,
  ROUND(recall, 9) AS recall, ROUND(fpr, 9) AS fpr FROM pts""")
def l9_pr_roc_curve_points(spark, sf):
    p = L.pr_points(_ls_tied(spark, sf), "p_a", "y")
    return p.select(r("threshold").alias("threshold"), F.col("tp").cast("bigint").alias("tp"),
                    F.col("fp").cast("bigint").alias("fp"), *[r(c, 9).alias(c) for c in ["precision", "recall", "fpr"]])


@query("l10_best_f1_on_curve", _g_sql("p_a", True, True) + PTS_SQL + """
SELECT ROUND(arg_max(threshold, (f1, -threshold)), 6) AS best_threshold, ROUND(MAX(f1), 9) AS best_f1
FROM (SELECT *, 2 * precision * recall / (precision + recall + 1e-9) AS f1 FROM pts WHERE before_full_recall)""")
def l10_best_f1_on_curve(spark, sf):
    b = L.best_f1_on_curve(_ls_tied(spark, sf), "p_a", "y")
    return b.select(r("best_threshold").alias("best_threshold"), r("best_f1", 9).alias("best_f1"))


@query("l11_best_f1_on_grid", f"""WITH {LS}, grid AS (SELECT CAST(ROUND(0.10 + i * 0.05, 2) AS DOUBLE) AS thr FROM range(16) t(i)),
g AS (SELECT thr, SUM(CASE WHEN p_a >= thr AND y = 1 THEN 1 ELSE 0 END) AS tp, SUM(CASE WHEN p_a >= thr AND y = 0 THEN 1 ELSE 0 END) AS fp,
      SUM(CASE WHEN p_a < thr AND y = 1 THEN 1 ELSE 0 END) AS fn FROM ls, grid GROUP BY thr),
m AS (SELECT thr, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS re FROM g),
f AS (SELECT thr, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1 FROM m)
SELECT ROUND(CASE WHEN MAX(f1) > 0 THEN arg_max(thr, (f1, -thr)) ELSE 0.5 END, 6) AS best_threshold, ROUND(MAX(f1), 9) AS best_f1 FROM f""")
def l11_best_f1_on_grid(spark, sf):
    b = L.best_f1_on_grid(_ls(spark, sf), "p_a", "y")
    return b.select(r("best_threshold").alias("best_threshold"), r("best_f1", 9).alias("best_f1"))


AG_SQL = """WITH m AS (SELECT a.TX_FRAUD AS pa, b.TX_FRAUD AS pb FROM scores_a a JOIN scores_b b USING (TX_ID)),
s AS (SELECT COUNT(*) AS n, AVG(CAST((pa >= 0.5) = (pb >= 0.5) AS DOUBLE)) * 100 AS bin_ag, AVG(CAST(pa = pb AS DOUBLE)) * 100 AS ex_ag,
  corr(pa, pb) AS r, AVG(abs(pa - pb)) AS mae, sqrt(AVG((pa - pb) * (pa - pb))) AS rmse,
  SUM(CASE WHEN pa < 0.5 AND pb < 0.5 THEN 1 ELSE 0 END) AS tn, SUM(CASE WHEN pa < 0.5 AND pb >= 0.5 THEN 1 ELSE 0 END) AS fp,
  SUM(CASE WHEN pa >= 0.5 AND pb < 0.5 THEN 1 ELSE 0 END) AS fn, SUM(CASE WHEN pa >= 0.5 AND pb >= 0.5 THEN 1 ELSE 0 END) AS tp,
  AVG(pa) AS m1, AVG(pb) AS m2, stddev_samp(pa) AS s1, stddev_samp(pb) AS s2, AVG(pa - pb) AS dm, stddev_samp(pa - pb) AS ds FROM m),
k AS (SELECT *, (tp + tn) / n AS po, ((tp + fn) / n) * ((tp + fp) / n) + ((tn + fp) / n) * ((tn + fn) / n) AS pe FROM s),
kk AS (SELECT *, CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) ELSE 0 END AS kappa FROM k)"""


@query("l12_score_agreement", AG_SQL + """
SELECT n AS common_transactions, ROUND(bin_ag, 6) AS binary_agreement_percentage, ROUND(ex_ag, 6) AS exact_agreement_percentage,
  ROUND(r, 6) AS correlation, ROUND(mae, 6) AS mean_absolute_error, ROUND(rmse, 6) AS root_mean_squared_error,
  CAST(tn AS BIGINT) AS true_negatives, CAST(fp AS BIGINT) AS false_positives, CAST(fn AS BIGINT) AS false_negatives,
  CAST(tp AS BIGINT) AS true_positives, ROUND(m1, 6) AS file1_mean, ROUND(m2, 6) AS file2_mean, ROUND(s1, 6) AS file1_std,
  ROUND(s2, 6) AS file2_std, ROUND(dm, 6) AS probability_difference_mean, ROUND(ds, 6) AS probability_difference_std,
  ROUND(kappa, 6) AS cohen_kappa FROM kk""")
def l12_score_agreement(spark, sf):
    t = tx(spark, sf)
    j = align_scores(adapter.scores_a(t), adapter.scores_b(t)).withColumnRenamed("TX_FRAUD_a", "p_a") \
        .withColumnRenamed("TX_FRAUD_b", "p_b")
    s = L.agreement(j)
    return s.select(*[r(c).alias(c) if dict(s.dtypes)[c] == "double" else F.col(c) for c in s.columns])


@query("l13_agreement_grades", AG_SQL + """
SELECT CASE WHEN bin_ag >= 95 THEN 'Excellent' WHEN bin_ag >= 85 THEN 'Good' WHEN bin_ag >= 70 THEN 'Moderate' ELSE 'Poor' END AS agreement_level,
  CASE WHEN kappa >= 0.81 THEN 'Almost Perfect' WHEN kappa >= 0.61 THEN 'Substantial' WHEN kappa >= 0.41 THEN 'Moderate'
       WHEN kappa >= 0.21 THEN 'Fair' ELSE 'Slight' END AS kappa_level,
  CASE WHEN abs(r) >= 0.7 THEN 'Strong' WHEN abs(r) >= 0.5 THEN 'Moderate' ELSE 'Weak' END AS correlation_strength FROM kk""")
def l13_agreement_grades(spark, sf):
    t = tx(spark, sf)
    j = align_scores(adapter.scores_a(t), adapter.scores_b(t)).withColumnRenamed("TX_FRAUD_a", "p_a") \
        .withColumnRenamed("TX_FRAUD_b", "p_b")
    return L.grades(L.agreement(j))


def _blend_sql():
    a = "LEAST(GREATEST(p_a, 1e-8), 1 - 1e-8)"
    b = "LEAST(GREATEST(p_b, 1e-8), 1 - 1e-8)"
    lg = lambda x: f"ln({x} / (1 - {x} + 1e-8) + 1e-8)"
    ent = lambda x: f"(-{x} * ln({x} + 1e-8) - (1 - {x}) * ln(1 - {x} + 1e-8))"
    ca, cb = f"abs({a} - 0.5) * 2", f"abs({b} - 0.5) * 2"
    dw = f"LEAST(GREATEST(0.6 + 0.2 * ({ca} - {cb}) / ({ca} + {cb} + 1e-8), 0.4), 0.8)"
    ra, rb = f"(1 / ({ent(a)} + 1e-8))", f"(1 / ({ent(b)} + 1e-8))"
    t = lambda x, tt: f"(1 / (1 + exp(-{lg(x)} / {tt})))"
    cols = {
        "m1_weighted": f"0.6 * {a} + 0.4 * {b}",
        "m3_confidence": f"{dw} * {a} + (1 - {dw}) * {b}",
        "m4_power": f"pow(0.6 * pow({a}, 1.5) + 0.4 * pow({b}, 1.5), 1 / 1.5)",
        "m5_geometric": f"pow({a}, 0.62) * pow({b}, 0.38)",
        "m6_harmonic": f"1 / (0.58 / {a} + 0.42 / {b} + 1e-8)",
        "m7_entropy": f"{ra} / ({ra} + {rb}) * {a} + (1 - {ra} / ({ra} + {rb})) * {b}",
        "m8_logit": f"1 / (1 + exp(-(0.65 * {lg(a)} + 0.35 * {lg(b)})))",
        "m10_temperature": f"0.65 * {t(a, 1.15)} + 0.35 * {t(b, 1.25)}",
        "m14_tuned": None,
    }
    w = [0.5, 0.4, 0.1]
    tot = sum(w)
    w1, w2, w3 = (x / tot for x in w)
    sa, sb = t(a, 1.0), t(b, 1.1)
    cols["m14_tuned"] = (f"{w1} * ({w1} * {sa} + {w2} * {sb}) + {w2} * (pow({sa}, {w1}) * pow({sb}, {w2}))"
                         f" + {w3} * (1 / ({w1} / {sa} + {w2} / {sb} + 1e-8))")
    body = ", ".join(f"ROUND({e}, 6) AS {n}" for n, e in cols.items())
    meta = (f"ROUND(0.4 * ({cols['m1_weighted']}) + 0.25 * ({cols['m3_confidence']}) + 0.35 * ({cols['m4_power']}), 6)"
            " AS m9_meta")
    return f"WITH {LS} SELECT TX_ID, {body}, {meta} FROM ls"


@query("m1_m14_blends", _blend_sql())
def m1_m14_blends(spark, sf):
    d = _ls(spark, sf)
    a, b = M.clip_probs("p_a"), M.clip_probs("p_b")
    d = d.select("TX_ID", a.alias("a"), b.alias("b"))
    cols = {
        "m1_weighted": M.weighted_mean("a", "b", 0.6),
        "m3_confidence": M.confidence_weighted("a", "b", 0.6),
        "m4_power": M.power_mean("a", "b", 0.6, 1.5),
        "m5_geometric": M.geometric_mean("a", "b", 0.62),
        "m6_harmonic": M.harmonic_mean("a", "b", 0.58),
        "m7_entropy": M.entropy_weighted("a", "b"),
        "m8_logit": M.logit_blend("a", "b", 0.65),
        "m10_temperature": M.weighted_mean(M.temperature("a", 1.15), M.temperature("b", 1.25), 0.65),
        "m14_tuned": M.tuned_blend("a", "b", 0.5, 0.4, 0.1, 1.0, 1.1),
    }
    d = d.select("TX_ID", *[c.alias(n) for n, c in cols.items()])
    meta = M.meta_blend({"m1_weighted": 0.4, "m3_confidence": 0.25, "m4_power": 0.35})
    return d.select("TX_ID", *[r(n).alias(n) for n in cols], r(meta).alias("m9_meta"))


@query("m2_rank_average", f"""WITH {LS},
ra AS (SELECT TX_ID, (rank() OVER (ORDER BY p_a) + (count(*) OVER (PARTITION BY p_a) - 1) / 2.0) / count(*) OVER () AS ra,
             (rank() OVER (ORDER BY ROUND(p_b, 2)) + (count(*) OVER (PARTITION BY ROUND(p_b, 2)) - 1) / 2.0) / count(*) OVER () AS rb FROM ls)
SELECT TX_ID, ROUND(0.6 * ra + 0.4 * rb, 6) AS rank_avg FROM ra""")
def m2_rank_average(spark, sf):
    d = _ls(spark, sf).withColumn("p_b", F.round("p_b", 2))
    return M.with_rank_average(d, "p_a", "p_b", "rank_avg").select("TX_ID", r("rank_avg").alias("rank_avg"))


@query("m11_platt_heuristic", f"""WITH {LS}, c AS (SELECT TX_ID, LEAST(GREATEST(p_a, 1e-8), 1 - 1e-8) AS p FROM ls),
st AS (SELECT AVG(p) AS m, stddev_pop(p) AS s FROM c),
ab AS (SELECT CASE WHEN s > 0 THEN 1 / s ELSE 1 END AS A, m FROM st)
SELECT TX_ID, ROUND(1 / (1 + exp(A * ln(p / (1 - p + 1e-8) + 1e-8) - A * ln(m / (1 - m + 1e-8) + 1e-8))), 6) AS platt FROM c, ab""")
def m11_platt_heuristic(spark, sf):
    d = _ls(spark, sf).select("TX_ID", M.clip_probs("p_a").alias("p"))
    return M.platt_heuristic(d, "p", "platt").select("TX_ID", r("platt").alias("platt"))


@query("m12_label_free_isotonic", f"""WITH {LS}, d AS (SELECT TX_ID, ROUND(p_b, 2) AS p FROM ls),
rk AS (SELECT TX_ID, rank() OVER (ORDER BY p) - 1 + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r0, count(*) OVER () AS n FROM d)
SELECT TX_ID, ROUND(CASE WHEN n > 1 THEN 0.001 + 0.998 * r0 / (n - 1) ELSE 0.001 END, 6) AS iso FROM rk""")
def m12_label_free_isotonic(spark, sf):
    d = _ls(spark, sf).select("TX_ID", F.round("p_b", 2).alias("p"))
    return M.with_label_free_isotonic(d, "p", "iso").select("TX_ID", r("iso").alias("iso"))


_GRID = ", ".join(f"({i}, {', '.join(map(str, p))})" for i, p in enumerate(M.default_grid()))
_WARM = "1.0 / (1.0 + exp(-ln({p} / (1 - {p} + 1e-8) + 1e-8) / {t}))"


@query("m13_blend_weight_search", f"""WITH {LS},
v AS (SELECT p_a, p_b, y FROM (SELECT ls.*, row_number() OVER (ORDER BY TX_TS, TX_ID) AS rn, COUNT(*) OVER () AS n FROM ls JOIN tx USING (TX_ID)) WHERE rn > floor(n * 0.8)),
g AS (SELECT gid, CAST(w1 AS DOUBLE) AS w1, CAST(w2 AS DOUBLE) AS w2, CAST(w3 AS DOUBLE) AS w3, CAST(t1 AS DOUBLE) AS t1, CAST(t2 AS DOUBLE) AS t2
  FROM (VALUES {_GRID}) AS x(gid, w1, w2, w3, t1, t2)),
s AS (SELECT gid, y, w1 / (w1 + w2 + w3) AS a, w2 / (w1 + w2 + w3) AS b, w3 / (w1 + w2 + w3) AS c, {_WARM.format(p='p_a', t='t1')} AS x, {_WARM.format(p='p_b', t='t2')} AS z FROM v, g),
k AS (SELECT gid, a * (a * x + b * z) + b * (x ** a * z ** b) + c * (1.0 / (a / x + b / z + 1e-8)) AS score, SUM(y) AS pos, COUNT(*) AS n FROM s GROUP BY 1, 2),
o AS (SELECT gid, pos, SUM(pos) OVER (PARTITION BY gid ORDER BY score DESC) AS cp, SUM(n) OVER (PARTITION BY gid ORDER BY score DESC) AS cn, SUM(pos) OVER (PARTITION BY gid) AS tp FROM k)
SELECT gid, ROUND(SUM(pos / tp * cp / cn), 6) AS average_precision, w1, w2, w3, t1, t2 FROM o JOIN g USING (gid) GROUP BY gid, w1, w2, w3, t1, t2""")
def m13_blend_weight_search(spark, sf):
    """M13 on the validation subset (A10, the latest fifth): the average precision of every grid point."""
    from frauddeck.operators.split import time_split
    valid = time_split(tx(spark, sf).select("TX_ID", "TX_TS")).filter("is_train = 0").select("TX_ID")
    res = M.search_blend_weights(_ls(spark, sf).join(valid, "TX_ID", "left_semi"))
    return res.select("gid", r("average_precision").alias("average_precision"), "w1", "w2", "w3", "t1", "t2")


@query("m13_blend_solver")
def m13_blend_solver(spark, sf):
    """M13 on the validation subset: the blend that a bounded search finds from the best grid point."""
    from frauddeck.operators.split import time_split
    valid = time_split(tx(spark, sf).select("TX_ID", "TX_TS")).filter("is_train = 0").select("TX_ID")
    best = M.solve_blend(_ls(spark, sf).join(valid, "TX_ID", "left_semi"))
    return spark.createDataFrame([tuple(float(best[c]) for c in ("w1", "w2", "w3", "t1", "t2", "average_precision"))],
                                 "w1 double, w2 double, w3 double, t1 double, t2 double, average_precision double")
