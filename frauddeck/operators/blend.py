"""Blending and calibration of two models' scores.

Inputs are aligned score columns (see :func:`frauddeck.operators.star.align_scores`).
Everything is a column expression except the rank-based blends (global ranks via
:mod:`globalrank`), the Platt statistics (one aggregation) and the weight search (a grid
of parameter rows crossed with the scored rows, scored by average precision per grid id).
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frauddeck.operators import globalrank
from frauddeck.operators.attach import attach_row

EPS = 1e-8


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clip_probs(c, eps: float = EPS) -> Column:
    return F.least(F.greatest(_c(c), F.lit(eps)), F.lit(1 - eps))


def weighted_mean(a, b, w: float = 0.6) -> Column:
    """M1."""
    return F.lit(w) * _c(a) + F.lit(1 - w) * _c(b)


def confidence_weighted(a, b, base: float = 0.6) -> Column:
    """M3: weight moves toward the more confident model, clipped to [0.4, 0.8]."""
    ca, cb = F.abs(_c(a) - 0.5) * 2, F.abs(_c(b) - 0.5) * 2
    w = F.lit(base) + 0.2 * (ca - cb) / (ca + cb + EPS)
    w = F.least(F.greatest(w, F.lit(0.4)), F.lit(0.8))
    return w * _c(a) + (1 - w) * _c(b)


def power_mean(a, b, w: float = 0.6, power: float = 2.0) -> Column:
    """M4."""
    return F.pow(F.lit(w) * F.pow(_c(a), power) + F.lit(1 - w) * F.pow(_c(b), power), 1.0 / power)


def geometric_mean(a, b, w: float = 0.6) -> Column:
    """M5."""
    return F.pow(_c(a), w) * F.pow(_c(b), 1 - w)


def harmonic_mean(a, b, w: float = 0.6) -> Column:
    """M6."""
    return 1.0 / (F.lit(w) / _c(a) + F.lit(1 - w) / _c(b) + EPS)


def _entropy(p: Column) -> Column:
    return -p * F.ln(p + EPS) - (1 - p) * F.ln(1 - p + EPS)


def entropy_weighted(a, b) -> Column:
    """M7: reliability = 1 / entropy; weight = reliability share."""
    ra, rb = 1.0 / (_entropy(_c(a)) + EPS), 1.0 / (_entropy(_c(b)) + EPS)
    w = ra / (ra + rb)
    return w * _c(a) + (1 - w) * _c(b)


def safe_logit(p) -> Column:
    """log(p / (1 - p + eps) + eps): the reference's eps-guarded logit."""
    return F.ln(_c(p) / (1 - _c(p) + EPS) + EPS)


def logit_blend(a, b, w: float = 0.65, eps_guard: bool = True) -> Column:
    """M8: sigmoid(w * logit(a) + (1-w) * logit(b)); ``eps_guard=False`` uses the plain logit."""
    la = safe_logit(a) if eps_guard else F.ln(_c(a) / (1 - _c(a)))
    lb = safe_logit(b) if eps_guard else F.ln(_c(b) / (1 - _c(b)))
    return 1.0 / (1.0 + F.exp(-(F.lit(w) * la + F.lit(1 - w) * lb)))


def temperature(p, t: float) -> Column:
    """sigmoid(logit(p) / t)."""
    return 1.0 / (1.0 + F.exp(-safe_logit(p) / t))


def platt_heuristic(df: DataFrame, col: str, out: str, sign: float = 1.0) -> DataFrame:
    """A = 1/std_pop (1 when 0), B = -A*logit(mean); p' = 1 / (1 + exp(sign*(A*logit(p) + B))).

    ``sign=1`` reproduces the reference (decreasing in the score, quirk Q8); ``-1`` is monotone.
    """
    st = df.agg(F.avg(col).alias("_m"), F.stddev_pop(col).alias("_s"))
    a = F.when(F.col("_s") > 0, 1.0 / F.col("_s")).otherwise(F.lit(1.0))
    b = -a * safe_logit(F.col("_m"))
    j = attach_row(df, st)
    return j.withColumn(out, 1.0 / (1.0 + F.exp(F.lit(sign) * (a * safe_logit(col) + b)))).drop("_m", "_s")


def with_rank_average(df: DataFrame, a: str, b: str, out: str, w: float = 0.6) -> DataFrame:
    """M2: weighted mean of the global average-rank percentiles of both scores."""
    d = globalrank.with_avg_rank_pct(df, a, "_ra")
    d = globalrank.with_avg_rank_pct(d, b, "_rb")
    return d.withColumn(out, F.lit(w) * F.col("_ra") + F.lit(1 - w) * F.col("_rb")).drop("_ra", "_rb")


def with_label_free_isotonic(df: DataFrame, col: str, out: str) -> DataFrame:
    """Monotone map of the score onto linspace(0.001, 0.999, n) by average rank (ties averaged)."""
    r = globalrank.value_counts_ranked(df, col)
    n = F.col("_grp_n")
    avg_rank0 = F.col("_cum__n") - F.col("_n") + (F.col("_n") - 1) / 2.0  # 0-based average position
    m = r.select(col, F.when(n > 1, 0.001 + 0.998 * avg_rank0 / (n - 1)).otherwise(F.lit(0.001)).alias(out))
    return df.join(m, col, "left")


def meta_blend(parts: dict[str, float]) -> Column:
    """M9: fixed-weight sum of already computed blend columns ``{column: weight}``."""
    expr = None
    for c, w in parts.items():
        term = F.lit(w) * F.col(c)
        expr = term if expr is None else expr + term
    return expr


def tuned_blend(a, b, w1: float, w2: float, w3: float, t1: float, t2: float, eps_guard: bool = True) -> Column:
    """Normalised weights; temperature-scaled inputs; w1*linear + w2*geometric + w3*harmonic."""
    tot = w1 + w2 + w3
    w1, w2, w3 = w1 / tot, w2 / tot, w3 / tot
    if eps_guard:
        sa, sb = temperature(a, t1), temperature(b, t2)
    else:
        sa = 1.0 / (1.0 + F.exp(-F.ln(_c(a) / (1 - _c(a))) / t1))
        sb = 1.0 / (1.0 + F.exp(-F.ln(_c(b) / (1 - _c(b))) / t2))
    linear = w1 * sa + w2 * sb
    geo = F.pow(sa, w1) * F.pow(sb, w2)
    har = 1.0 / (w1 / sa + w2 / sb + EPS)
    return w1 * linear + w2 * geo + w3 * har


def default_grid() -> list[tuple[float, float, float, float, float]]:
    """M13 search space (the reference's bounds, coarse): 3 x 3 x 2 x 3 x 3 = 162 points."""
    return list(itertools.product([0.1, 0.45, 0.8], [0.1, 0.45, 0.8], [0.05, 0.3], [0.8, 1.15, 1.5],
                                  [0.8, 1.15, 1.5]))


def search_blend_weights(df: DataFrame, a: str = "p_a", b: str = "p_b", label: str = "y",
                         grid: list | None = None) -> DataFrame:
    """Average precision of the tuned blend for every grid point; returns all points ranked.

    Work is |grid| x distinct pairs of scores: equal pairs collapse to counts, a literal array of
    the parameter points is exploded for each, and the scored rows are shuffled once, by ranges of
    (grid, score), for the AP per grid id. Meant for the validation subset (A10), as the fit it is.
    """
    return _scored_points(_score_pairs(df, a, b, label), grid or default_grid())


def _score_pairs(df: DataFrame, a: str, b: str, label: str) -> DataFrame:
    """Distinct pairs of scores with their positives and rows, in as many partitions as a shuffle has: the pairs
    are few bytes, which adaptive execution would put into one task, but each is scored for every point."""
    pairs = df.groupBy(F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.sum(F.col(label).cast("double")).alias("_y"), F.count(F.lit(1)).alias("_w"))
    return pairs.repartition(globalrank.default_parts(df))


def _scored_points(pairs: DataFrame, grid: list) -> DataFrame:
    """The average precision of each parameter point, all in one pass over the pairs."""
    spark = pairs.sparkSession
    g = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(grid)],
                              "gid int, w1 double, w2 double, w3 double, t1 double, t2 double")
    params = F.array(*[F.struct(F.lit(i).alias("gid"), *[F.lit(float(v)).alias(n) for n, v in
                                                        zip(["w1", "w2", "w3", "t1", "t2"], p)])
                       for i, p in enumerate(grid)])
    j = pairs.select("_a", "_b", "_y", "_w", F.explode(params).alias("_g")).select("_a", "_b", "_y", "_w", "_g.*")
    tot = F.col("w1") + F.col("w2") + F.col("w3")
    w1, w2, w3 = F.col("w1") / tot, F.col("w2") / tot, F.col("w3") / tot
    sa = 1.0 / (1.0 + F.exp(-safe_logit("_a") / F.col("t1")))
    sb = 1.0 / (1.0 + F.exp(-safe_logit("_b") / F.col("t2")))
    ens = w1 * (w1 * sa + w2 * sb) + w2 * (F.pow(sa, w1) * F.pow(sb, w2)) + w3 * (1.0 / (w1 / sa + w2 / sb + EPS))
    ap = globalrank.average_precisions(j.select("gid", ens.alias("_s"), "_y", "_w").where("_s is not null"), "gid", "_s", "_y", "_w")
    return ap.join(F.broadcast(g), "gid")


#: Bounds of the blend's weights and temperatures (fixed values).
BLEND_BOUNDS = [(0.1, 0.8), (0.1, 0.8), (0.05, 0.3), (0.8, 1.5), (0.8, 1.5)]


def neighbours(point: tuple[float, ...], steps: list[float], bounds: list[tuple[float, float]]) -> list[tuple[float, ...]]:
    """The point a step up and a step down in each coordinate, within the bounds."""
    out = []
    for i, (step, (lo, hi)) in enumerate(zip(steps, bounds)):
        for v in (min(point[i] + step, hi), max(point[i] - step, lo)):
            if v != point[i]:
                out.append((*point[:i], v, *point[i + 1:]))
    return out


def solve_blend(df: DataFrame, a: str = "p_a", b: str = "p_b", label: str = "y", *, start: list | None = None,
                bounds: list[tuple[float, float]] | None = None, tolerance: float = 0.01, rounds: int = 60) -> dict:
    """M13, bounded search: weights and temperatures of the best average precision found.

    From the best of ``start`` (default: the grid) a compass search tries a step up and down in each
    coordinate, all points of a round in one pass over the distinct score pairs. The best of them
    is taken if it beats the point; otherwise the steps, a quarter of the bounds at first, are halved,
    until they are below ``tolerance`` of the bounds. Of equal points the first one counts.
    """
    from frauddeck.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    bounds = bounds or BLEND_BOUNDS
    pairs = _score_pairs(df, a, b, label).checkpoint()

    def best_of(points: list) -> tuple[float, tuple[float, ...]]:
        got = {r["gid"]: r["average_precision"] for r in _scored_points(pairs, points).select("gid", "average_precision").collect()}  # a row for each point
        at = min(range(len(points)), key=lambda i: (-(got.get(i) or 0.0), i))
        return got.get(at) or 0.0, tuple(map(float, points[at]))

    value, point = best_of(start or default_grid())
    steps, share, n = [(hi - lo) / 4 for lo, hi in bounds], 0.25, 0
    while share >= tolerance and n < rounds:
        n += 1
        found, there = best_of(neighbours(point, steps, bounds))
        if found > value + 1e-12:
            value, point = found, there
        else:
            steps, share = [x / 2 for x in steps], share / 2
    return {**dict(zip(["w1", "w2", "w3", "t1", "t2"], point)), "average_precision": value, "rounds": n}
