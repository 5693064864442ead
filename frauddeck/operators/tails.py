"""Distribution tails and fits of the profiling reports, in plain arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS = 200
_TINY = 1e-300


def _log_beta_front(a: Column) -> Column:
    """ln of 1 / B(a, 1/2) = ln(gamma(a + 1/2) / gamma(a)) - ln(pi) / 2, for a >= 1/2.

    The ratio is taken 20 places higher, where its asymptotic series has all digits, and brought down
    by the recurrence of gamma; no large logarithms are subtracted.
    """
    shift = 20
    z = a + shift
    series = F.log(z) / 2 - 1 / (8 * z) + 1 / (192 * F.pow(z, 3)) - 1 / (640 * F.pow(z, 5)) + 17 / (14336 * F.pow(z, 7))
    down = F.aggregate(F.sequence(F.lit(0), F.lit(shift - 1)), F.lit(0.0), lambda acc, i: acc + F.log((a + i) / (a + i + 0.5)))
    return series + down - math.log(math.pi) / 2


def _continued_fraction(a: Column, b: Column, x: Column) -> Column:
    """The incomplete beta function's continued fraction, by Lentz's method, ``STEPS`` pairs of terms."""
    def safe(v: Column) -> Column:
        return F.when(F.abs(v) < _TINY, F.lit(_TINY)).otherwise(v)

    def term(acc: Column, factor) -> Column:
        d = 1.0 / safe(1.0 + factor * acc["d"])
        c = safe(1.0 + factor / acc["c"])
        return F.struct(c.alias("c"), d.alias("d"), (acc["h"] * d * c).alias("h"))

    d0 = 1.0 / safe(1.0 - (a + b) * x / (a + 1.0))
    start = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))

    def even(acc: Column, k: Column) -> Column:
        return term(acc, k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)))

    def odd(acc: Column, k: Column) -> Column:
        return term(acc, -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1)))

    # a term at a time: the numbers 2, 3, 4, 5 ... stand for even(1), odd(1), even(2), odd(2) ...
    def step(acc: Column, i: Column) -> Column:
        k = F.floor(i / 2).cast("double")
        return F.when(i % 2 == 0, even(acc, k)).otherwise(odd(acc, k))

    return F.aggregate(F.sequence(F.lit(2), F.lit(2 * STEPS + 1)), start, step, lambda acc: acc["h"])


def pearson_p_value(r: Column, n: Column) -> Column:
    """Two-sided p-value of a Pearson correlation of n pairs: Student's t with n - 2 degrees of freedom,
    ``I(1 - r^2; (n - 2) / 2, 1/2)``. Null for fewer than three pairs; 0 for a correlation of 1."""
    r, n = r.cast("double"), n.cast("double")
    a, b = (n - 2) / 2, F.lit(0.5)
    x = (1 - r) * (1 + r)
    front = F.exp(a * F.log1p(-r * r) + F.log(F.abs(r)) + _log_beta_front(a))
    by_tail = front * _continued_fraction(a, b, x) / a
    by_body = 1 - front * _continued_fraction(b, a, r * r) / b
    p = F.when(r == 0, F.lit(1.0)).when(x <= 0, F.lit(0.0)).when(x < (a + 1) / (a + b + 2), by_tail).otherwise(by_body)
    return F.when(n > 2, p)


# ---------------------------------------------------------------- truncated normal

def _mass(lo: float, hi: float) -> float:
    """The standard normal's mass in [lo, hi], by the tail that keeps digits."""
    if lo > 0:
        lo, hi = -hi, -lo
    return 0.5 * (math.erfc(-hi / math.sqrt(2)) - math.erfc(-lo / math.sqrt(2)))


def _moments(mu: float, sigma: float, lo: float, hi: float) -> list[float]:
    """The first four raw moments of a normal cut to [lo, hi]."""
    a, b = (lo - mu) / sigma, (hi - mu) / sigma
    z = _mass(a, b)
    phi = lambda t: math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
    std = [1.0]
    for k in range(1, 5):  # moments of the standardised variable, by parts
        std.append((k - 1) * (std[k - 2] if k > 1 else 0.0) - (b ** (k - 1) * phi(b) - a ** (k - 1) * phi(a)) / z)
    return [sum(math.comb(k, j) * mu ** (k - j) * sigma ** j * std[j] for j in range(k + 1)) for k in range(1, 5)]


def fit_truncated_normal(n: int, total: float, squares: float, lo: float, hi: float, *, tolerance: float = 1e-12, steps: int = 200) -> tuple[float, float] | None:
    """Maximum likelihood ``(mu, sigma)`` of a normal cut to [lo, hi], from the sufficient statistics.

    Newton steps, halved while they don't raise the likelihood, on the natural parameters
    ``mu / sigma^2`` and ``-1 / (2 sigma^2)`` of values brought to [-1, 1]; the likelihood is concave in
    these. None if there is no such normal: no width, fewer than two values, or values spread at
    least as widely as a uniform would.
    """
    if n < 2 or not hi > lo:
        return None
    c, s = (lo + hi) / 2, (hi - lo) / 2
    m1 = (total / n - c) / s
    m2 = (squares / n - 2 * c * total / n + c * c) / (s * s)
    if m2 - m1 * m1 <= 0:
        return None

    def likelihood(e1: float, e2: float) -> float:
        sigma = math.sqrt(-0.5 / e2)
        mu = e1 * sigma * sigma
        z = _mass((-1 - mu) / sigma, (1 - mu) / sigma)
        if z <= 0:
            return -math.inf
        return e1 * m1 + e2 * m2 - (math.log(z) + math.log(sigma) + mu * mu / (2 * sigma * sigma))

    var = m2 - m1 * m1
    e1, e2 = m1 / var, -0.5 / var
    value = likelihood(e1, e2)
    for _ in range(steps):
        sigma = math.sqrt(-0.5 / e2)
        r = _moments(e1 * sigma * sigma, sigma, -1.0, 1.0)
        g1, g2 = m1 - r[0], m2 - r[1]
        h11, h12, h22 = r[1] - r[0] ** 2, r[2] - r[0] * r[1], r[3] - r[1] ** 2
        det = h11 * h22 - h12 * h12
        if det <= 0:
            return None
        d1, d2 = (h22 * g1 - h12 * g2) / det, (h11 * g2 - h12 * g1) / det
        t = 1.0
        while t > 1e-12 and (e2 + t * d2 >= 0 or (new := likelihood(e1 + t * d1, e2 + t * d2)) < value - 1e-15):
            t /= 2
        if t <= 1e-12:
            break
        e1, e2, value = e1 + t * d1, e2 + t * d2, new
        if e2 > -1e-6:  # flatter than any normal that the values could tell from a uniform
            return None
        if max(abs(t * d1) / (1 + abs(e1)), abs(t * d2) / (1 + abs(e2))) < tolerance:
            break
    sigma = math.sqrt(-0.5 / e2)
    return c + s * e1 * sigma * sigma, s * sigma


def truncated_normal(df: DataFrame, amount: str = "TX_AMOUNT", label: str = "TX_FRAUD") -> DataFrame:
    """One row with the normal, cut to the observed range, that fits the amounts of positive rows:
    ``mu, sigma`` (null if there is none), ``lo, hi, n``. One aggregation of the rows."""
    x = F.col(amount).cast("double")
    r = df.filter((F.col(label) == 1) & x.isNotNull()).agg(F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.avg(x).alias("m"), F.var_pop(x).alias("v")).first()
    n, m, v = r["n"], r["m"] or 0.0, r["v"] or 0.0
    # sums about the mean keep their digits
    found = fit_truncated_normal(n, 0.0, n * v, r["lo"] - m, r["hi"] - m) if n else None
    mu, sigma = (m + found[0], found[1]) if found else (None, None)
    return df.sparkSession.createDataFrame([(mu, sigma, r["lo"], r["hi"], n)], "mu double, sigma double, lo double, hi double, n long")
