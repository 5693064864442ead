"""Classification metrics and score-file agreement.

Curve metrics never sort all rows in one task: rows are first collapsed to one row per
distinct score with positive / negative counts (partial aggregation), then cumulative
counts come from :func:`globalrank.prefix_sums` over the distinct scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frauddeck.operators import globalrank
from frauddeck.operators.attach import attach_row


def _y(label: str) -> Column:
    return F.col(label).cast("double")


def confusion(df: DataFrame, label: str = "y", pred: str = "pred") -> DataFrame:
    """L1: one row tn, fp, fn, tp."""
    y, p = F.col(label), F.col(pred)
    c = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")
    return df.agg(c((y == 0) & (p == 0)).alias("tn"), c((y == 0) & (p == 1)).alias("fp"),
                  c((y == 1) & (p == 0)).alias("fn"), c((y == 1) & (p == 1)).alias("tp"))


def _sd(num: Column, den: Column) -> Column:
    """Zero-division -> 0 (sklearn ``zero_division=0``)."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def class_report(df: DataFrame, label: str = "y", pred: str = "pred") -> DataFrame:
    """L4: per-class precision, recall, F1 and support from one ``groupBy(label, pred)``."""
    cnt = df.groupBy(label, pred).agg(F.count(F.lit(1)).alias("n"))  # one row per (label, pred) cell
    # each cell contributes to its label's support, its prediction's count and (diagonal) tp
    contrib = cnt.select(F.explode(F.array(
        F.struct(F.col(label).alias("cls"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("pred_n"),
                 F.col("n").alias("support")),
        F.struct(F.col(pred).alias("cls"), F.when(F.col(label) == F.col(pred), F.col("n")).otherwise(0).alias("tp"),
                 F.col("n").alias("pred_n"), F.lit(0).cast("bigint").alias("support")))).alias("c")).select("c.*")
    per = contrib.groupBy("cls").agg(F.sum("tp").alias("tp"), F.sum("pred_n").alias("pred_n"),
                                     F.sum("support").alias("support"))
    prec, rec = _sd(F.col("tp"), F.col("pred_n")), _sd(F.col("tp"), F.col("support"))
    return per.select(F.col("cls").alias("class"), prec.alias("precision"), rec.alias("recall"),
                      _sd(2 * prec * rec, prec + rec).alias("f1"), F.col("support").cast("bigint").alias("support"))


def summary_metrics(df: DataFrame, label: str = "y", pred: str = "pred") -> DataFrame:
    """L2 / L3: accuracy, support-weighted P/R/F1, macro F1 and positive-class P/R/F1."""
    rep = class_report(df, label, pred)
    tot = F.sum("support")
    w = rep.agg(
        (F.sum(F.col("precision") * F.col("support")) / tot).alias("precision_weighted"),
        (F.sum(F.col("recall") * F.col("support")) / tot).alias("recall_weighted"),
        (F.sum(F.col("f1") * F.col("support")) / tot).alias("f1_weighted"),
        F.avg("f1").alias("f1_macro"),
        F.max(F.when(F.col("class") == 1, F.col("precision"))).alias("precision_pos"),
        F.max(F.when(F.col("class") == 1, F.col("recall"))).alias("recall_pos"),
        F.max(F.when(F.col("class") == 1, F.col("f1"))).alias("f1_pos"))
    acc = df.agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"))
    return attach_row(acc, w).select("accuracy", "precision_weighted", "recall_weighted", "f1_weighted", "f1_macro",
                                   *[F.coalesce(F.col(c), F.lit(0.0)).alias(c)
                                     for c in ["precision_pos", "recall_pos", "f1_pos"]])


def score_counts(df: DataFrame, score: str, label: str, *, descending: bool) -> DataFrame:
    """One row per distinct score with pos/neg counts and cumulative counts in score order."""
    y = _y(label)
    r = globalrank.value_counts_ranked(
        df.filter(F.col(label).isNotNull()), score, descending=descending,
        extra_sums={"_pos": F.sum(y), "_neg": F.sum(1 - y)})
    return r


def roc_auc(df: DataFrame, score: str = "p", label: str = "y") -> DataFrame:
    """Tie-correct ROC AUC = sum(pos * (neg below + neg tied / 2)) / (P * N); one class -> 0.5."""
    r = score_counts(df, score, label, descending=False)
    neg_below = F.col("_cum__neg") - F.col("_neg")
    a = r.agg(F.sum(F.col("_pos") * (neg_below + F.col("_neg") / 2)).alias("_s"),
              F.sum("_pos").alias("_P"), F.sum("_neg").alias("_N"))
    return a.select(F.when((F.col("_P") > 0) & (F.col("_N") > 0), F.col("_s") / (F.col("_P") * F.col("_N")))
                    .otherwise(F.lit(0.5)).alias("roc_auc"))


def pr_points(df: DataFrame, score: str = "p", label: str = "y") -> DataFrame:
    """One PR/ROC point per distinct score (threshold), with previous-point values.

    Columns: threshold, tp, fp (cumulative at >= threshold), precision, recall, fpr, tpr,
    prev_precision / prev_recall (the point of the next higher threshold, or (1, 0)),
    ``P`` positives, ``N`` negatives.
    """
    r = score_counts(df, score, label, descending=True)
    tot = r.agg(F.sum("_pos").alias("_P_all"), F.sum("_neg").alias("_N_all"))
    r = attach_row(r, tot)
    tp, fp = F.col("_cum__pos"), F.col("_cum__neg")
    tp0, fp0 = tp - F.col("_pos"), fp - F.col("_neg")
    P, N = F.col("_P_all"), F.col("_N_all")
    return r.select(
        F.col(score).alias("threshold"), tp.alias("tp"), fp.alias("fp"), F.col("_pos").alias("pos"),
        P.alias("P"), N.alias("N"),
        _sd(tp, tp + fp).alias("precision"), _sd(tp, P).alias("recall"),
        _sd(fp, N).alias("fpr"), _sd(tp, P).alias("tpr"),
        F.when(tp0 + fp0 == 0, F.lit(1.0)).otherwise(tp0 / (tp0 + fp0)).alias("prev_precision"),
        _sd(tp0, P).alias("prev_recall"), (tp0 < P).alias("before_full_recall"))


def average_precision(df: DataFrame, score: str = "p", label: str = "y") -> DataFrame:
    """Step AP = sum over thresholds of (recall_i - recall_{i-1}) * precision_i."""
    pts = pr_points(df, score, label)
    return pts.agg(F.sum(F.col("pos") / F.col("P") * F.col("precision")).alias("average_precision"))


def pr_auc_trapezoid(df: DataFrame, score: str = "p", label: str = "y") -> DataFrame:
    """Trapezoid area under the PR curve incl. the (recall 0, precision 1) end point.

    Points after full recall is first reached are not part of the curve (as in the usual
    precision-recall curve construction).
    """
    pts = pr_points(df, score, label).filter("before_full_recall")
    area = (F.col("recall") - F.col("prev_recall")) * (F.col("precision") + F.col("prev_precision")) / 2
    return pts.agg(F.coalesce(F.sum(area), F.lit(0.0)).alias("pr_auc"))


def best_f1_on_curve(df: DataFrame, score: str = "p", label: str = "y") -> DataFrame:
    """Threshold maximising F1 = 2PR/(P+R+1e-9) over the curve; ties -> lowest threshold."""
    pts = pr_points(df, score, label).filter("before_full_recall")
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-9)
    pts = pts.withColumn("f1", f1)
    return pts.agg(F.max_by(F.struct("threshold", "f1"), F.struct(F.col("f1"), -F.col("threshold"))).alias("b")) \
              .select(F.col("b.threshold").alias("best_threshold"), F.col("b.f1").alias("best_f1"))


def best_f1_on_grid(df: DataFrame, score: str = "p", label: str = "y", *, lo: float = 0.10, hi: float = 0.85,
                    step: float = 0.05, default: float = 0.5) -> DataFrame:
    """F1 of the positive class on a fixed threshold grid; best (first on ties) else default.

    The grid (16 rows) is broadcast; each row is compared with every threshold in one
    aggregation grouped by threshold.
    """
    n = int(round((hi - lo) / step)) + 1
    thr = [round(lo + i * step, 2) for i in range(n)]
    y, p = F.col(label), F.col(score)
    # level = how many grid thresholds the score reaches (0..n); one aggregation per level
    level = F.lit(0)
    for t in thr:
        level = level + F.when(p >= F.lit(t), 1).otherwise(0)
    lv = df.filter(p.isNotNull()).groupBy(level.alias("lv")).agg(
        F.sum(F.when(y == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(y == 0, 1).otherwise(0)).alias("neg"))
    # threshold i (1-based) is reached by every level >= i: suffix sums over at most n+1 rows
    from pyspark.sql import Window
    suffix = Window.orderBy(F.col("lv").desc()).rowsBetween(Window.unboundedPreceding, 0)
    tot_pos = Window.orderBy("lv").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = df.sparkSession.createDataFrame([(i + 1, float(t)) for i, t in enumerate(thr)], "lv int, thr double")
    full = levels.join(lv, "lv", "full").select(F.col("lv"), "thr", F.coalesce("pos", F.lit(0)).alias("pos"),
                                                 F.coalesce("neg", F.lit(0)).alias("neg"))
    g = full.select("lv", "thr", F.sum("pos").over(suffix).alias("tp"), F.sum("neg").over(suffix).alias("fp"),
                    (F.sum("pos").over(tot_pos) - F.sum("pos").over(suffix)).alias("fn")).filter(F.col("thr").isNotNull())
    prec, rec = _sd(F.col("tp"), F.col("tp") + F.col("fp")), _sd(F.col("tp"), F.col("tp") + F.col("fn"))
    g = g.withColumn("f1", _sd(2 * prec * rec, prec + rec))
    best = g.agg(F.max_by(F.struct("thr", "f1"), F.struct(F.col("f1"), -F.col("thr"))).alias("b"))
    return best.select(F.when(F.col("b.f1") > 0, F.col("b.thr")).otherwise(F.lit(default)).alias("best_threshold"),
                       F.coalesce(F.col("b.f1"), F.lit(0.0)).alias("best_f1"))


def agreement(aligned: DataFrame, a: str = "p_a", b: str = "p_b", threshold: float = 0.5) -> DataFrame:
    """Agreement of two aligned score columns in one aggregation (+ Cohen's kappa)."""
    pa, pb = F.col(a), F.col(b)
    ba, bb = (pa >= threshold).cast("int"), (pb >= threshold).cast("int")
    c = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")
    d = pa - pb
    s = aligned.agg(
        F.count(F.lit(1)).alias("common_transactions"),
        (F.avg((ba == bb).cast("double")) * 100).alias("binary_agreement_percentage"),
        (F.avg((pa == pb).cast("double")) * 100).alias("exact_agreement_percentage"),
        F.corr(pa, pb).alias("correlation"), F.avg(F.abs(d)).alias("mean_absolute_error"),
        F.sqrt(F.avg(d * d)).alias("root_mean_squared_error"),
        c((ba == 0) & (bb == 0)).alias("true_negatives"), c((ba == 0) & (bb == 1)).alias("false_positives"),
        c((ba == 1) & (bb == 0)).alias("false_negatives"), c((ba == 1) & (bb == 1)).alias("true_positives"),
        F.avg(pa).alias("file1_mean"), F.avg(pb).alias("file2_mean"),
        F.stddev_samp(pa).alias("file1_std"), F.stddev_samp(pb).alias("file2_std"),
        F.avg(d).alias("probability_difference_mean"), F.stddev_samp(d).alias("probability_difference_std"))
    n = F.col("common_transactions")
    tn, fp, fn, tp = (F.col(x) for x in ["true_negatives", "false_positives", "false_negatives", "true_positives"])
    po = (tp + tn) / n
    pe = ((tp + fn) / n) * ((tp + fp) / n) + ((tn + fp) / n) * ((tn + fn) / n)
    kappa = F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(F.lit(0.0))
    return s.withColumn("cohen_kappa", kappa)


def grades(stats: DataFrame, keep: bool = False) -> DataFrame:
    """Verbal bands for agreement %, kappa and |r| (``keep`` keeps the statistics too)."""
    a, k, r = F.col("binary_agreement_percentage"), F.col("cohen_kappa"), F.abs(F.col("correlation"))
    return stats.select(*(["*"] if keep else []),
        F.when(a >= 95, "Excellent").when(a >= 85, "Good").when(a >= 70, "Moderate").otherwise("Poor").alias("agreement_level"),
        F.when(k >= 0.81, "Almost Perfect").when(k >= 0.61, "Substantial").when(k >= 0.41, "Moderate")
         .when(k >= 0.21, "Fair").otherwise("Slight").alias("kappa_level"),
        F.when(r >= 0.7, "Strong").when(r >= 0.5, "Moderate").otherwise("Weak").alias("correlation_strength"))
