"""Table cleaning operators.

Dedup uses ``row_number`` over an explicit order (``dropDuplicates`` keeps an arbitrary
row). The order always ends in enough columns to be total, so results are repeatable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frauddeck.functions import scalars as S
from frauddeck.operators.attach import attach_row


def dedup_keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """B1: one row per key, the first in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_dd", F.row_number().over(w)).filter("_dd = 1").drop("_dd")


def dedup_keep_latest(df: DataFrame, key: str = "TX_ID", ts: str = "TX_TS", tie: list | None = None) -> DataFrame:
    """B2: one row per ``key``, the one with the latest ``ts``."""
    return dedup_keep_first(df, [key], [F.col(ts).desc_nulls_last(), *(tie or [])])


def drop_null_required(df: DataFrame, cols: list[str]) -> DataFrame:
    """B3."""
    return df.na.drop(subset=list(cols))


def fill_zero_all(df: DataFrame) -> DataFrame:
    """Numeric NULL -> 0 and string NULL -> "0" (pandas ``fillna(0)`` fills both)."""
    return df.fillna(0).fillna("0")


def project_features(df: DataFrame, features: list[str], keep: list[str] = ()) -> DataFrame:
    """Keep ``keep`` columns, then each feature as double; missing features -> 0.

    Feature presence is tested case-insensitively (quirk Q1).
    """
    lower = {c.lower(): c for c in df.columns}
    cols = [F.col(c) for c in keep if c in df.columns]
    for f in features:
        src = lower.get(f.lower())
        cols.append((F.col(src).cast("double") if src else F.lit(0.0)).alias(f))
    return df.select(*cols)


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename columns present in ``mapping`` (e.g. ``y_terminal__id`` -> ``y_terminal_id``)."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def drop_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop leakage / low-value columns that are present."""
    return df.drop(*[c for c in cols if c in df.columns])


def filter_rows(df: DataFrame, cond) -> DataFrame:
    """Row filter by label / flag / set membership (pushed down by Catalyst)."""
    return df.filter(cond)


def select_present(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Optional-column selection."""
    return df.select(*[c for c in wanted if c in df.columns])


def impute_median(df: DataFrame, cols: list[str]) -> DataFrame:
    """NULL -> column median (exact, linear), one median per column.

    Medians come from :func:`globalrank.exact_quantile` (distributed) and are attached as a
    one-row frame.
    """
    from frauddeck.operators.globalrank import exact_quantile
    out = df
    for c in cols:
        med = exact_quantile(df, c, 0.5).select(F.col(f"q_{c}").alias(f"_med_{c}"))
        out = attach_row(out, med).withColumn(c, F.coalesce(F.col(c), F.col(f"_med_{c}"))) \
                 .drop(f"_med_{c}")
    return out


def null_tokens(df: DataFrame, cols: list[str], token: str = "MISSING") -> DataFrame:
    """Declared categoricals that are present -> string with a NULL token."""
    present = [c for c in cols if c in df.columns]
    return df.withColumns({c: S.null_token(c, token) for c in present})


# ------------------------------------------------------------------ P1: clean five tables

def clean_customers(df: DataFrame, key="CUSTOMER_ID", x="x_customer_id", y="y_customer_id") -> DataFrame:
    d = dedup_keep_first(df, [key], [F.col(x).asc_nulls_last(), F.col(y).asc_nulls_last()])
    d = drop_null_required(d, [key, x, y])
    return d.withColumns({x: S.clip(x, 0.0, 100.0), y: S.clip(y, 0.0, 100.0)})


def clean_terminals(df: DataFrame, key="TERMINAL_ID", x="x_terminal_id", y="y_terminal_id") -> DataFrame:
    return clean_customers(df, key, x, y)


PCT_COLS = ["PAYMENT_PERCENTAGE_FACE_TO_FACE", "PAYMENT_PERCENTAGE_ECOM", "PAYMENT_PERCENTAGE_MOTO",
            "DEPOSIT_REQUIRED_PERCENTAGE", "DEPOSIT_PERCENTAGE", "DELIVERY_SAME_DAYS_PERCENTAGE",
            "DELIVERY_WEEK_ONE_PERCENTAGE", "DELIVERY_WEEK_TWO_PERCENTAGE", "DELIVERY_OVER_TWO_WEEKS_PERCENTAGE"]
MONEY_COLS = ["ANNUAL_TURNOVER_CARD", "ANNUAL_TURNOVER", "AVERAGE_TICKET_SALE_AMOUNT"]


def clean_merchants(df: DataFrame, key="MERCHANT_ID") -> DataFrame:
    d = dedup_keep_first(df, [key], [F.col(c).asc_nulls_last() for c in df.columns if c != key])
    upd = {c: S.clip(c, 0.0, 100.0) for c in PCT_COLS if c in d.columns}
    upd.update({c: S.zero_floor(c) for c in MONEY_COLS if c in d.columns})
    if "TAX_EXCEMPT_INDICATOR" in d.columns:
        upd["TAX_EXCEMPT_INDICATOR"] = S.fuzzy_bool("TAX_EXCEMPT_INDICATOR")
    d = d.withColumns(upd)
    return d.drop(*[c for c in ["LEGAL_NAME", "FOUNDATION_DATE", "ACTIVE_FROM", "TRADING_FROM"] if c in d.columns])


def clean_transactions(df: DataFrame, *, is_train: bool = True, keep_id: bool = True) -> DataFrame:
    """B2, B3, B5, B6, B7, B8, B9, B10. ``TX_ID`` is kept (quirk Q4)."""
    tie = [F.col(c).asc_nulls_last() for c in ["CUSTOMER_ID", "TERMINAL_ID", "TX_AMOUNT"] if c in df.columns]
    d = dedup_keep_latest(df, "TX_ID", "TX_TS", tie)
    d = drop_null_required(d, ["TX_ID", "CUSTOMER_ID", "TERMINAL_ID", "TX_TS"])
    upd: dict[str, Column] = {}
    if "IS_RECURRING_TRANSACTION" in d.columns:
        upd["IS_RECURRING_TRANSACTION"] = S.fuzzy_bool("IS_RECURRING_TRANSACTION")
    amt, g, cb = "TX_AMOUNT", "TRANSACTION_GOODS_AND_SERVICES_AMOUNT", "TRANSACTION_CASHBACK_AMOUNT"
    upd.update({c: S.zero_floor(c) for c in [amt, g, cb] if c in d.columns})
    d = d.withColumns(upd)
    if g in d.columns and cb in d.columns:
        ng, ncb = S.rescale_parts(g, cb, amt)
        d = d.withColumns({g: ng, cb: ncb})
    if "CARD_EXPIRY_DATE" in d.columns:
        m, y = S.expiry_month_year("CARD_EXPIRY_DATE")
        d = d.withColumns({"card_expiry_month_clean": m, "card_expiry_year_clean": y})
    if is_train and "TX_FRAUD" in d.columns:
        d = d.withColumn("TX_FRAUD", S.label01("TX_FRAUD"))
    d = d.drop(*[c for c in ["CARD_EXPIRY_DATE", "TRANSACTION_STATUS", "FAILURE_CODE", "FAILURE_REASON"]
                 if c in d.columns])
    if not keep_id:
        d = d.drop("TX_ID")
    return d
