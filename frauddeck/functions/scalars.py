"""Pure ``Column -> Column`` functions: cleaning rules, calendar, geometry, flags.

All built on ``pyspark.sql.functions`` so they stay inside whole-stage codegen.
Null rules follow the pandas behaviour the reference relies on (see SURVEY 1.3):
ANSI-safe parsing (``try_*``), NULL-preserving clips, Monday=0 weekdays.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

C = F.col


def _c(x) -> Column:
    return C(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- cleaning

def clip(c, lo=None, hi=None) -> Column:
    """Clip to [lo, hi]; NULL stays NULL (Spark ``greatest`` alone would skip NULLs)."""
    c = _c(c)
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(c.isNotNull(), out)


def zero_floor(c) -> Column:
    """NULL -> 0 then clip below at 0."""
    return F.greatest(F.coalesce(_c(c).cast("double"), F.lit(0.0)), F.lit(0.0))


# The token sets of the fuzzy boolean parser.
TRUE_WORDS = ["1", "true", "t", "yes", "y"]
FALSE_WORDS = ["0", "false", "f", "no", "n"]


def fuzzy_bool(c) -> Column:
    """trim+lower; known words; else first letter t/y -> true; everything else false."""
    s = F.lower(F.trim(_c(c).cast("string")))
    return (F.when(s.isNull(), F.lit(False))
            .when(s.isin(TRUE_WORDS), F.lit(True))
            .when(s.isin(FALSE_WORDS), F.lit(False))
            .when(s.startswith("t") | s.startswith("y"), F.lit(True))
            .otherwise(F.lit(False)))


def expiry_month_year(c) -> tuple[Column, Column]:
    """``MM/YY`` -> (month, 2000+YY) as doubles; anything invalid -> (NULL, NULL).

    Exactly one ``/`` with integer parts is required (the reference unpacks a 2-way split).
    """
    s = _c(c).cast("string")
    parts = F.split(s, "/")
    mm = F.trim(F.get(parts, 0)).try_cast("int")
    yy = F.trim(F.get(parts, 1)).try_cast("int")
    ok = (s.contains("/") & (F.size(parts) == 2) & mm.isNotNull() & yy.isNotNull()
          & (mm >= 1) & (mm <= 12))
    return (F.when(ok, mm.cast("double")), F.when(ok, (yy + 2000).cast("double")))


def rescale_parts(goods, cashback, amount) -> tuple[Column, Column]:
    """When goods+cashback exceeds the amount, scale both parts down to it."""
    g, cb, a = _c(goods), _c(cashback), _c(amount)
    total = g + cb
    safe = F.when(total == 0, F.lit(1.0)).otherwise(total)
    over = total > a
    return (F.when(over, F.greatest(g * a / safe, F.lit(0.0))).otherwise(g),
            F.when(over, F.greatest(cb * a / safe, F.lit(0.0))).otherwise(cb))


def label01(c) -> Column:
    """NULL -> 0, integer, clipped to 0..1."""
    return F.least(F.greatest(F.coalesce(_c(c).cast("int"), F.lit(0)), F.lit(0)), F.lit(1))


def null_token(c, token: str = "MISSING") -> Column:
    """Cast to string, NULL -> token."""
    return F.coalesce(_c(c).cast("string"), F.lit(token))


def to_number_or_zero(c) -> Column:
    """Coerce to double; anything unparsable -> 0."""
    return F.coalesce(_c(c).cast("string").try_cast("double"), F.lit(0.0))


def clip_score(c) -> Column:
    """Clip a score to [0, 1] (NULL preserved)."""
    return clip(c, 0.0, 1.0)


def binarise(c, threshold: float = 0.5, strict: bool = False) -> Column:
    """1 when score >= threshold (``strict``: >)."""
    c = _c(c)
    return (c > threshold if strict else c >= threshold).cast("int")


# ---------------------------------------------------------------- date / time

def parse_ts(c, fmt: str | None = None) -> Column:
    """H1: parse a timestamp, invalid -> NULL (``errors='coerce'``)."""
    c = _c(c)
    if fmt:
        return F.try_to_timestamp(c.cast("string"), F.lit(fmt))
    return F.try_to_timestamp(c.cast("string"))


def epoch_us(ts) -> Column:
    """Microseconds since epoch of a (naive, UTC) timestamp."""
    return F.unix_micros(_c(ts).cast("timestamp"))


def epoch_s(ts) -> Column:
    """Whole seconds since epoch (H3 / E3 ``TX_TS_unix``)."""
    return F.unix_seconds(_c(ts).cast("timestamp"))


def weekday(ts) -> Column:
    """H2: Monday=0 .. Sunday=6 (pandas ``dayofweek``)."""
    return F.weekday(_c(ts))


def time_of_day(ts) -> Column:
    """H3: (h*3600 + m*60 + s) / 86400 with whole seconds."""
    t = _c(ts)
    return (F.hour(t) * 3600 + F.minute(t) * 60 + F.floor(F.second(t))) / 86400.0


def is_weekend(ts) -> Column:
    """H4: Saturday or Sunday."""
    return weekday(ts).isin(5, 6).cast("int")


def is_night(hour) -> Column:
    """H4: hour >= 22 or <= 6."""
    h = _c(hour)
    return ((h >= 22) | (h <= 6)).cast("int")


def is_business_hours(hour) -> Column:
    """H4: 9 <= hour <= 17."""
    h = _c(hour)
    return ((h >= 9) & (h <= 17)).cast("int")


def hour_bands(hour, day) -> dict[str, Column]:
    """H5: early morning 3-7, late night 23-2, lunch 11-14, rush 7-9/17-19, month start/end."""
    h, d = _c(hour), _c(day)
    return {
        "is_early_morning": ((h >= 3) & (h <= 7)).cast("int"),
        "is_late_night": ((h >= 23) | (h <= 2)).cast("int"),
        "is_lunch_time": ((h >= 11) & (h <= 14)).cast("int"),
        "is_rush_hour": (((h >= 7) & (h <= 9)) | ((h >= 17) & (h <= 19))).cast("int"),
        "is_month_start": (d <= 3).cast("int"),
        "is_month_end": (d >= 28).cast("int"),
    }


# Hour -> risk level 0..3 (hours 0..23 in order).
HOUR_RISK = [3, 3, 3, 3, 2, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 1, 1, 2, 2, 3]
# High- and low-risk hours (H7, used with :func:`in_flag`).
HIGH_RISK_HOURS = [4, 8, 10, 11, 18]
LOW_RISK_HOURS = [12, 20, 23]


def hour_risk(hour) -> Column:
    """H6: literal map lookup (a ``create_map`` folds to a constant)."""
    m = F.create_map(*[x for h, r in enumerate(HOUR_RISK) for x in (F.lit(h), F.lit(r))])
    return m[_c(hour)]


def months_between30(d1, d2) -> Column:
    """H8: (y2-y1)*12 + (m2-m1) + (day2-day1)/30 (not Spark's /31 ``months_between``)."""
    a, b = _c(d1), _c(d2)
    return ((F.year(b) - F.year(a)) * 12 + (F.month(b) - F.month(a))
            + (F.dayofmonth(b) - F.dayofmonth(a)) / 30.0)


def expiry_date28(month, year) -> Column:
    """H9: expiry day = 28th of the expiry month; NULL when month/year missing."""
    return F.make_date(_c(year).cast("int"), _c(month).cast("int"), F.lit(28))


def floor_days(later, earlier) -> Column:
    """Whole days between two instants, floored toward -inf like pandas ``.dt.days``."""
    return F.floor((epoch_us(later) - epoch_us(earlier)) / 86_400_000_000.0).cast("bigint")


def days_to_expiry(expiry_str, ts, default: int = 365) -> Column:
    """Days from ``ts`` to the first day of the ``MM/yy`` expiry month; NULL -> default."""
    exp = F.try_to_timestamp(_c(expiry_str), F.lit("MM/yy"))
    return F.coalesce(floor_days(exp, ts), F.lit(default).cast("bigint"))


def merchant_age_days(ts, foundation, default: int = 1000) -> Column:
    """Whole days from the foundation date to the transaction; NULL -> default."""
    return F.coalesce(floor_days(ts, _c(foundation).cast("timestamp")), F.lit(default).cast("bigint"))


def split_part(c, sep: str, i: int) -> Column:
    """I-th piece of a split (0-based), NULL when absent (no ANSI index error)."""
    return F.get(F.split(_c(c), sep), i)


def expiry_parts_raw(c) -> dict[str, Column]:
    """Month, 2000+year and card age (2024 - year) from ``MM/YY`` without validation."""
    m = split_part(c, "/", 0).try_cast("int")
    y = split_part(c, "/", 1).try_cast("int") + 2000
    return {"card_expiry_month": m, "card_expiry_year": y, "card_age": F.lit(2024) - y}


# ---------------------------------------------------------------- math

def distance(x1, y1, x2, y2, null_to_zero: bool = False) -> Column:
    """Euclidean distance."""
    d = F.sqrt(F.pow(_c(x1) - _c(x2), 2) + F.pow(_c(y1) - _c(y2), 2))
    return F.coalesce(d, F.lit(0.0)) if null_to_zero else d


def centre_features(xc, yc, xt, yt) -> dict[str, Column]:
    """Distance to (50,50), inside the 25-75 box, both inside."""
    inside = lambda x, y: ((_c(x) > 25) & (_c(x) < 75) & (_c(y) > 25) & (_c(y) < 75)).cast("int")
    ci, ti = inside(xc, yc), inside(xt, yt)
    return {
        "distance_from_center_cust": distance(xc, yc, F.lit(50.0), F.lit(50.0)),
        "distance_from_center_term": distance(xt, yt, F.lit(50.0), F.lit(50.0)),
        "customer_in_center": F.coalesce(ci, F.lit(0)),
        "terminal_in_center": F.coalesce(ti, F.lit(0)),
        "both_in_center": F.coalesce(ci * ti, F.lit(0)),
    }


def same_quadrant(xc, yc, xt, yt) -> Column:
    q = lambda x, y: (F.when(_c(x) >= 50, 1).otherwise(0) * 2 + F.when(_c(y) >= 50, 1).otherwise(0))
    return (q(xc, yc) == q(xt, yt)).cast("int")


def log1p0(c) -> Column:
    """log1p of a non-negative amount, NULL -> 0 and clipped at 0 first."""
    return F.log1p(zero_floor(c))


def ratio(num, den, eps: float = 1e-8) -> Column:
    """Num / (den + eps). (H15 distance x amount is a plain product.)"""
    return _c(num) / (_c(den) + F.lit(eps))


def round_flags(amount) -> dict[str, Column]:
    """Multiples of 10, of 100, and amounts with cents (pandas float ``%``)."""
    a = _c(amount)
    return {
        "is_round_amount": (a % 10 == 0).cast("int"),
        "is_very_round_amount": (a % 100 == 0).cast("int"),
        "amount_has_cents": (a % 1 != 0).cast("int"),
    }


def amount_bands(amount) -> dict[str, Column]:
    """The amount bands used as flags across the reference scripts."""
    a = _c(amount)
    f = lambda cond: F.coalesce(cond.cast("int"), F.lit(0))
    return {
        "is_small_amount": f(a < 10),
        "is_large_amount": f(a > 1000),
        "is_medium_amount": f((a >= 50) & (a <= 200)),
        "is_medium_high_amount": f((a >= 100) & (a < 200)),
        "is_very_high_amount": f(a >= 200),
        "is_fraud_critical_amount": f((a >= 100) & (a <= 500)),
        "is_fraud_amount_range": f((a >= 500) & (a <= 1000)),
    }


def band_weight(amount, lo=500.0, hi=1000.0, w=2.0) -> Column:
    """Sample weight ``w`` inside [lo, hi], else 1."""
    a = _c(amount)
    return F.when((a >= lo) & (a <= hi), F.lit(w)).otherwise(F.lit(1.0))


def cashback_features(amount, goods, cashback) -> dict[str, Column]:
    """Cashback present, ratio > 0.1, goods-total mismatch > 1, cashback log."""
    a, g, cb = _c(amount), _c(goods), _c(cashback)
    return {
        "has_cashback": F.coalesce((cb > 0).cast("int"), F.lit(0)),
        "high_cashback_ratio": F.coalesce((ratio(cb, a) > 0.1).cast("int"), F.lit(0)),
        "cashback_amount_log": F.log1p(cb),
        "goods_vs_total_mismatch": F.coalesce((F.abs(g - a) > 1).cast("int"), F.lit(0)),
    }


def merchant_flags(deposit_req, deposit, ecom, f2f, moto, same_day, slow) -> dict[str, Column]:
    """Deposit risk and gap; outlet-mix and delivery flags (NULL compare -> 0)."""
    f = lambda cond: F.coalesce(cond.cast("int"), F.lit(0))
    return {
        "merchant_deposit_risk": f(_c(deposit_req) > _c(deposit)),
        "deposit_gap": _c(deposit_req) - _c(deposit),
        "high_ecom": f(_c(ecom) > 50),
        "high_face_to_face": f(_c(f2f) > 80),
        "high_moto": f(_c(moto) > 20),
        "same_day_delivery": f(_c(same_day) > 50),
        "slow_delivery_risk": f(_c(slow) > 30),
    }


def logit(p, eps: float | None = 1e-8) -> Column:
    """log(p / (1-p)), optionally after clipping to [eps, 1-eps]."""
    q = _c(p) if eps is None else F.least(F.greatest(_c(p), F.lit(eps)), F.lit(1 - eps))
    return F.ln(q / (1 - q))


def sigmoid(z) -> Column:
    return 1.0 / (1.0 + F.exp(-_c(z)))


def binary_entropy(p, eps: float = 1e-8) -> Column:
    q = _c(p)
    return -(q * F.ln(q + eps) + (1 - q) * F.ln(1 - q + eps))


# ---------------------------------------------------------------- strings / flags

def pan_parts(pan) -> dict[str, Column]:
    """First digit, first four, last four of a masked PAN; issuer from the first digit."""
    p = _c(pan).cast("string")
    first = F.substring(p, 1, 1)
    return {
        "card_first_digit": first,
        "card_bin4": F.substring(p, 1, 4),
        "card_last4": F.right(p, F.lit(4)),
        "card_issuer": (F.when(first == "3", "amex").when(first == "4", "visa")
                        .when(first == "5", "mastercard").when(first == "6", "discover")
                        .otherwise("other")),
    }


def contains_flag(c, needle: str) -> Column:
    """Substring test, NULL -> 0."""
    return F.coalesce(_c(c).contains(needle).cast("int"), F.lit(0))


def eq_flag(c, value) -> Column:
    """Equality as 0/1, NULL -> 0."""
    return F.coalesce((_c(c) == F.lit(value)).cast("int"), F.lit(0))


def in_flag(c, values) -> Column:
    """Membership as 0/1, NULL -> 0."""
    return F.coalesce(_c(c).isin(list(values)).cast("int"), F.lit(0))


def ordinal_map(c, mapping: dict, default=0) -> Column:
    """Literal map with a default for unknown or NULL values."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[_c(c)], F.lit(default))


def not_null_flag(c) -> Column:
    """H30."""
    return _c(c).isNotNull().cast("int")


def bool_int(c) -> Column:
    """Boolean -> 0/1 with NULL -> 0. H32: the recurring flag is ``bool_int(fuzzy_bool(c))``
    (fixes quirk Q3). H31 interaction flags are products of these 0/1 columns."""
    return F.coalesce(_c(c).cast("boolean"), F.lit(False)).cast("int")


# The flag sets used by the unified feature table.
HIGH_RISK_CURRENCIES = ["RON", "AED"]
HIGH_RISK_COUNTRIES = ["AE", "RO", "FI"]
HIGH_RISK_ACQUIRERS = ["ACQ5", "ACQ6"]
