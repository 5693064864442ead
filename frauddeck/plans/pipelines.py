"""Composite pipelines as lazy DataFrame plans.

Shuffle plan of the feature builders: dimension joins are left to Catalyst/AQE
(size-checked broadcast), history windows run once per entity key on the raw columns
(one bucketed shuffle per key, see :mod:`frauddeck.operators.windows`), and every derived
scalar is computed in one final projection so it does not widen the shuffled rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frauddeck.functions import scalars as S
from frauddeck.operators import clean, encode, profile, split, star, windows as W
from frauddeck.operators.globalrank import exact_quantile, with_avg_rank_pct
from frauddeck.operators.attach import attach_row
from frauddeck.sources.io import written


def p1_clean(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Clean the five input tables."""
    out = {"customers": clean.clean_customers(tables["customers"]),
           "terminals": clean.clean_terminals(tables["terminals"]),
           "merchants": clean.clean_merchants(tables["merchants"]),
           "transactions": clean.clean_transactions(tables["transactions"], is_train=True)}
    if "transactions_test" in tables:
        out["transactions_test"] = clean.clean_transactions(tables["transactions_test"], is_train=False)
    return out


TX_ORDER = ["TX_TS", "CUSTOMER_ID", "TERMINAL_ID", "MERCHANT_ID", "TX_AMOUNT"]


def one_row_per_tx(tx: DataFrame) -> DataFrame:
    """B1 on ``TX_ID``: the earliest row of a repeated id, so that blocks joined on it stay one to one."""
    return clean.dedup_keep_first(tx, ["TX_ID"], [c for c in TX_ORDER if c in tx.columns])


#: Narrow rows a task sorts in memory.
ROWS_PER_TASK = 500_000


def _dealt(df: DataFrame, key: str, n: int, always: bool = True) -> DataFrame:
    """``df`` of about ``n`` rows dealt out by ``key``; to more tasks than a shuffle has where those would hold more
    than ``ROWS_PER_TASK``, so that sorts stay in memory. Not ``always``: otherwise as it is."""
    tasks = -(-n // ROWS_PER_TASK)
    if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df.repartition(tasks, key)
    return df.repartition(key) if always else df


def _with_dim(h: DataFrame, dim: DataFrame, key: str, out: str, keep: list[str]) -> DataFrame:
    """``h`` with the dimension's rows of its key as an array ``out``."""
    return h.join(star.packed(dim.select(key, *[c for c in dim.columns if c != key and c in keep]), key, out), key, "left")


def _meet(base: DataFrame, block: DataFrame, of_keys: list[str]) -> DataFrame:
    """``base`` with the columns of ``block`` by ``TX_ID``; a row without an id has only what is told by its
    keys (``of_keys``), no history."""
    cols = [c if c in of_keys else F.when(F.col("TX_ID").isNotNull(), F.col(c)).alias(c) for c in block.columns if c != "TX_ID"]
    return base.join(block.select(F.col("TX_ID").alias("_id"), *cols), F.col("TX_ID").eqNullSafe(F.col("_id")), "left").drop("_id")


# P2's feature list, label-coded and frequency-coded columns.
P2_CODES = ["CARD_BRAND", "TRANSACTION_TYPE", "TRANSACTION_CURRENCY", "CARD_COUNTRY_CODE", "ACQUIRER_ID", "BUSINESS_TYPE", "MCC_CODE", "OUTLET_TYPE"]
P2_FREQS = ["CUSTOMER_ID", "TERMINAL_ID", "MERCHANT_ID", "CARD_DATA", "MCC_CODE", "BUSINESS_TYPE", "ACQUIRER_ID", "CARD_COUNTRY_CODE"]
P2_FEATURES = [
    "tx_hour", "tx_dow", "tx_day", "tx_month", "months_to_expiry", "amount_log1p", "goods_ratio", "cashback_ratio",
    "x_customer_id", "y_customer_id", "x_terminal_id", "y_terminal_id", "cust_term_dist",
    "ANNUAL_TURNOVER_CARD_log1p", "AVERAGE_TICKET_SALE_AMOUNT_log1p",
    "PAYMENT_PERCENTAGE_FACE_TO_FACE", "PAYMENT_PERCENTAGE_ECOM", "PAYMENT_PERCENTAGE_MOTO", "DEPOSIT_REQUIRED_PERCENTAGE", "DEPOSIT_PERCENTAGE",
    "DELIVERY_SAME_DAYS_PERCENTAGE", "DELIVERY_WEEK_ONE_PERCENTAGE", "DELIVERY_WEEK_TWO_PERCENTAGE", "DELIVERY_OVER_TWO_WEEKS_PERCENTAGE",
    "merchant_tax_exempt_int", "is_recurring_int",
    "time_since_last_CUSTOMER_ID_sec", "count_24h_CUSTOMER_ID", "count_7d_CUSTOMER_ID",
    "time_since_last_TERMINAL_ID_sec", "count_24h_TERMINAL_ID", "count_7d_TERMINAL_ID",
    "z_amt_CUSTOMER_ID", "z_amt_TERMINAL_ID", "z_amt_MERCHANT_ID", "dist_prev_terminal", "velocity_customer",
]


def p2_feature_table_v1(tx: DataFrame, customers: DataFrame, terminals: DataFrame, merchants: DataFrame,
                        *, reference: DataFrame | None = None) -> DataFrame:
    """The 37 numeric features, 8 label codes and 8 log-count encodings as doubles, with the id and label
    (B1, C1, H2, H16, H17, H9, H13, E1, E11, E12, E13, I2, I6, B12).

    Codes and counts come from ``reference`` (the training rows; default ``tx`` itself): codes of
    unseen values are -1, counts 0. Rows are written once; narrow rows go from key to key (customer,
    terminal, merchant), each time with its history and its dimension as an array, and meet the wide
    rows by ``TX_ID``.
    """
    base = written(one_row_per_tx(tx))  # read by each block and encoding
    n = base.count()
    narrow = base.select("TX_ID", "TX_TS", "CUSTOMER_ID", "TERMINAL_ID", "MERCHANT_ID", "TX_AMOUNT")
    place = terminals.select("TERMINAL_ID", *P3_TERMINAL)

    def entity(key, p, hop=False):
        m_, s_ = F.coalesce(W.prior_mean(p), F.lit(0.0)), F.coalesce(W.prior_std(p), F.lit(0.0))
        out = {f"z_amt_{key}": (F.col("TX_AMOUNT") - m_) / (s_ + 1e-6)}
        if key != "MERCHANT_ID":
            out[f"time_since_last_{key}_sec"] = F.coalesce(W.seconds_since_prev(p), F.lit(1e9))
        if hop:
            out["dist_prev_terminal"] = F.coalesce(S.distance("x_terminal_id", "y_terminal_id", f"{p}prev_x_terminal_id", f"{p}prev_y_terminal_id"), F.lit(0.0))
        return out
    # a terminal listed twice doubles the rows of this block, so it has a shuffle of its own
    hops = W.history_block(star.star_join(narrow.drop("MERCHANT_ID"), terminals=place), ["CUSTOMER_ID"], entity("CUSTOMER_ID", "_c", True),
                           lags=["x_terminal_id", "y_terminal_id"], p="_c")
    h = W.add_time_window_counts(narrow.repartition("CUSTOMER_ID"), "CUSTOMER_ID", n_rows=n, unique=True, keys_of=base)
    h = _with_dim(h, customers, "CUSTOMER_ID", "_customer", P3_CUSTOMER).drop("CUSTOMER_ID")
    seen = h.columns
    h = W.prior_history(h.repartition("TERMINAL_ID"), ["TERMINAL_ID"], p="_t", n_rows=n, keys_of=base)
    h = h.select(*seen, *[c.alias(x) for x, c in entity("TERMINAL_ID", "_t").items()])
    h = W.add_time_window_counts(h, "TERMINAL_ID", n_rows=n, unique=True, keys_of=base)
    h = _with_dim(h, place, "TERMINAL_ID", "_terminal", P3_TERMINAL).drop("TERMINAL_ID")
    seen = [c for c in h.columns if c not in ("TX_TS", "TX_AMOUNT", "MERCHANT_ID")]
    h = W.prior_history(h.repartition("MERCHANT_ID"), ["MERCHANT_ID"], p="_m", n_rows=n, keys_of=base)
    h = h.select("MERCHANT_ID", *seen, *[c.alias(x) for x, c in entity("MERCHANT_ID", "_m").items()])
    h = _with_dim(h, merchants, "MERCHANT_ID", "_merchant", P2_MERCHANT).drop("MERCHANT_ID")
    dims = ["_merchant", "_customer", "_terminal"]
    d = star.unpacked(_meet(base, h, dims).join(hops, "TX_ID", "left"), dims)
    m, y = S.expiry_month_year("CARD_EXPIRY_DATE")
    amt = S.zero_floor("TX_AMOUNT")
    total = F.coalesce(F.col("TX_AMOUNT"), F.lit(0.0))
    d = d.withColumns({
        "tx_hour": F.hour("TX_TS"), "tx_dow": S.weekday("TX_TS"), "tx_day": F.dayofmonth("TX_TS"), "tx_month": F.month("TX_TS"),
        "amount_log1p": F.log1p(amt),
        "cashback_ratio": S.ratio(F.coalesce(F.col("TRANSACTION_CASHBACK_AMOUNT"), F.lit(0.0)), total, 1e-6),
        "goods_ratio": S.ratio(F.coalesce(F.col("TRANSACTION_GOODS_AND_SERVICES_AMOUNT"), F.lit(0.0)), total, 1e-6),
        "months_to_expiry": S.months_between30("TX_TS", S.expiry_date28(m, y)),
        "cust_term_dist": S.distance("x_customer_id", "y_customer_id", "x_terminal_id", "y_terminal_id"),
        "ANNUAL_TURNOVER_CARD_log1p": S.log1p0("ANNUAL_TURNOVER_CARD"),
        "AVERAGE_TICKET_SALE_AMOUNT_log1p": S.log1p0("AVERAGE_TICKET_SALE_AMOUNT"),
        "merchant_tax_exempt_int": S.bool_int(S.fuzzy_bool("TAX_EXCEMPT_INDICATOR")),
        "is_recurring_int": S.bool_int(S.fuzzy_bool("IS_RECURRING_TRANSACTION")),
        "velocity_customer": F.col("dist_prev_terminal") / F.greatest(F.col("time_since_last_CUSTOMER_ID_sec"), F.lit(1.0)),
    })
    # fitted on the narrow training rows, not on the featured frame
    ref = one_row_per_tx(reference) if reference is not None else base
    ref = star.star_join(ref.select("MERCHANT_ID", "CUSTOMER_ID", "TERMINAL_ID", "CARD_DATA", *[c for c in P2_CODES if c in ref.columns]),
                         merchants=merchants.select("MERCHANT_ID", "MCC_CODE", "BUSINESS_TYPE", "OUTLET_TYPE"))
    counts = encode.value_counts(ref, list(dict.fromkeys([*P2_CODES, *P2_FREQS])))
    codes = encode.codes_of(counts, P2_CODES)
    for c in P2_CODES:
        d = encode.apply_codes(d, c, codes[c], unseen="minus_one", out=f"{c}_code")
    d = encode.log_count_encode(d, P2_FREQS, counts=counts)
    keep = ["TX_ID"] + (["TX_FRAUD"] if "TX_FRAUD" in d.columns else [])
    return clean.project_features(d, [*P2_FEATURES, *[f"{c}_code" for c in P2_CODES], *[f"freq_{c}" for c in P2_FREQS]], keep)


# The dimensions' columns that P2 and P3 need.
P2_MERCHANT = ["MCC_CODE", "BUSINESS_TYPE", "OUTLET_TYPE", "TAX_EXCEMPT_INDICATOR", "ANNUAL_TURNOVER_CARD", "AVERAGE_TICKET_SALE_AMOUNT",
               *[c for c in P2_FEATURES if "PERCENTAGE" in c]]
P3_CUSTOMER, P3_TERMINAL = ["x_customer_id", "y_customer_id"], ["x_terminal_id", "y_terminal_id"]
P3_MERCHANT = ["MCC_CODE", "BUSINESS_TYPE", "OUTLET_TYPE", "FOUNDATION_DATE", "TAX_EXCEMPT_INDICATOR", "ANNUAL_TURNOVER_CARD", "ANNUAL_TURNOVER",
               "AVERAGE_TICKET_SALE_AMOUNT", "PAYMENT_PERCENTAGE_FACE_TO_FACE", "PAYMENT_PERCENTAGE_ECOM", "PAYMENT_PERCENTAGE_MOTO",
               "DEPOSIT_REQUIRED_PERCENTAGE", "DEPOSIT_PERCENTAGE", "DELIVERY_SAME_DAYS_PERCENTAGE", "DELIVERY_OVER_TWO_WEEKS_PERCENTAGE"]


def p3_unified_features(tx: DataFrame, customers: DataFrame, terminals: DataFrame, merchants: DataFrame, *,
                        label_source: DataFrame | None = None, reference: DataFrame | None = None, bad_min_count: int = 5,
                        bad_threshold: float = 1.0) -> DataFrame:
    """The unified ~100-feature table (D17, C1, E1-E6, E9, E10, E14, E17, H*, B1).

    Terminals are flagged by the labels of ``label_source``; the median and the category shares are
    those of ``reference`` (both default to ``tx``: give the training rows where others are scored).
    A repeated ``TX_ID`` keeps its earliest row. One narrow row for each id is written and counted once. Terminal
    history and, after it, customer (and, without another exchange, customer-merchant) history are windows over
    it, the merchant percentile is one beside them; what they add meets the wide rows by ``TX_ID``, so that no column is
    shuffled for a key that it doesn't need. Terminals' flags and each dimension join the narrow rows while they
    lie by its key, the latter as an array (a repeated key has several rows) that is unpacked at the
    end, so wide rows are shuffled once, by ``TX_ID``.
    """
    own_label = label_source is None
    base = written(tx.select("TX_ID", *TX_ORDER, *(["TX_FRAUD"] if own_label else [])))
    per_id = base.groupBy(F.xxhash64("TX_ID"), F.col("TX_ID").isNull().alias("_none")).agg(F.count(F.lit(1)).alias("_n"))
    n, copies, none = per_id.agg(F.sum("_n"), F.max("_n"), F.max("_none")).first()
    if (copies or 1) > 1:  # or two ids of one hash, however unlikely: then nothing is dropped
        tx, base = one_row_per_tx(tx), written(one_row_per_tx(base))
        n = base.count()
    src = base if own_label else label_source
    bad = profile.compromised_entities(src, "TERMINAL_ID", min_count=bad_min_count, threshold=bad_threshold)
    ref = reference if reference is not None else base
    median = exact_quantile(ref, "TX_AMOUNT", 0.5).select(F.col("q_TX_AMOUNT").alias("_median"))
    # a row without an id meets no block; the flag is its terminal's all the same
    lone = bool(none) and not star.membership_flag(base.where("TX_ID is null").select("TERMINAL_ID"), bad, "TERMINAL_ID", "_bad").where("_bad = 1").isEmpty()

    keys = base.select("TX_ID", "TX_TS", "CUSTOMER_ID", "TERMINAL_ID", "MERCHANT_ID", "TX_AMOUNT")
    h = W.prior_history(_dealt(keys, "TERMINAL_ID", n), ["TERMINAL_ID"], value=None, p="_t", n_rows=n, keys_of=base)
    h = star.membership_flag(_with_dim(h, terminals, "TERMINAL_ID", "_terminal", P3_TERMINAL), bad, "TERMINAL_ID", "is_fraudulent_terminal")
    of_terminal = {"_t_rn": F.col("_trn"), "_t_prev_us": F.col("_tprev__us"), "_terminal": F.col("_terminal"), "is_fraudulent_terminal": F.col("is_fraudulent_terminal")}
    narrow = h.select("TX_ID", "TX_TS", "CUSTOMER_ID", "MERCHANT_ID", "TX_AMOUNT", *[c.alias(x) for x, c in of_terminal.items()])
    h = W.prior_history(_dealt(narrow, "CUSTOMER_ID", n), ["CUSTOMER_ID"], last_n=[3, 5, 9, 10], p="_c", n_rows=n, finer=["MERCHANT_ID"], finer_p="_m", keys_of=base)
    own = {"_c_rn": F.col("_crn"), "_c_prev_us": F.col("_cprev__us"), "_c_pm": W.prior_mean("_c"), "_c_ps": W.prior_std("_c"), "_c_px": F.col("_cmax"),
           "_c_m10": (F.coalesce(F.col("_cl9_sum"), F.lit(0.0)) + F.col("TX_AMOUNT")) / (F.col("_cl9_cnt") + 1),
           "_m_rn": F.col("_mrn"), "_m_prev_us": F.col("_mprev__us")}
    for k in (3, 5, 10):
        full = F.col(f"_cl{k}_cnt") == k
        own |= {f"_c_l{k}_mean": F.when(full, W.lastn_mean(k, "_c")), f"_c_l{k}_std": F.when(full, W.lastn_std(k, "_c"))}
    block = _with_dim(h, customers, "CUSTOMER_ID", "_customer", P3_CUSTOMER).select("TX_ID", "_customer", *of_terminal, *[c.alias(x) for x, c in own.items()])
    ranked = W.add_rank_pct(_dealt(keys.select("TX_ID", "MERCHANT_ID", "TX_AMOUNT"), "MERCHANT_ID", n), "TX_AMOUNT", "amount_percentile_merchant", keys=["MERCHANT_ID"], n_rows=n, keys_of=base)
    ranked = _with_dim(ranked, merchants, "MERCHANT_ID", "_merchant", P3_MERCHANT).select("TX_ID", "amount_percentile_merchant", "_merchant")
    wide, block, ranked = (_dealt(x, "TX_ID", n, always=False) for x in (tx, block, ranked))
    d = wide.join(block, "TX_ID", "left").join(ranked, "TX_ID", "left").withColumn("is_fraudulent_terminal", F.coalesce("is_fraudulent_terminal", F.lit(int(lone))))
    d = attach_row(star.unpacked(d, ["_merchant", "_customer", "_terminal"]), median)
    # fitted on narrow rows (not on ``d``) so the feature plan is not executed twice
    mcc_ref = ref.select("MERCHANT_ID").join(merchants.select("MERCHANT_ID", "MCC_CODE"), "MERCHANT_ID", "left")
    d = encode.frequency_encode(d, "MCC_CODE", "mcc_frequency", reference=mcc_ref)

    amt, med, us = F.col("TX_AMOUNT"), F.col("_median"), S.epoch_us("TX_TS")
    h = F.hour("TX_TS")
    pm = F.coalesce(F.col("_c_pm"), med)
    ps = F.coalesce(F.col("_c_ps"), F.lit(0.0))
    px = F.coalesce(F.col("_c_px"), med)
    m10 = F.col("_c_m10")
    dist = S.distance("x_customer_id", "y_customer_id", "x_terminal_id", "y_terminal_id", null_to_zero=True)
    sec = lambda p: (us - F.col(f"{p}_prev_us")) / 1e6
    unix_s = S.epoch_s("TX_TS")
    cols = {
        "TX_AMOUNT_log": F.log1p(amt), "distance": dist, "distance_tx": dist * amt,
        "hour": h, "dayofweek": S.weekday("TX_TS"), "is_weekend": S.is_weekend("TX_TS"), "is_night": S.is_night(h),
        "time_of_day": S.time_of_day("TX_TS"), "is_business_hours": S.is_business_hours(h),
        "tx_hour_risk": S.hour_risk(h),
        "time_since_last_tx": F.coalesce(sec("_c"), F.lit(86400.0)),
        "time_since_last_tx_merchant": F.coalesce(sec("_m"), F.lit(86400.0 * 30)),
        "cust_tx_count_cumm": F.col("_c_rn"), "cust_merchant_pair_count_cumm": F.col("_m_rn") - 1,
        "cust_avg_amount_cumm": pm, "cust_std_amount_cumm": ps, "cust_max_amount_cumm": px,
        "amount_deviation": F.coalesce((amt - pm) / F.when(ps == 0, 1.0).otherwise(ps), F.lit(0.0)),
        "amount_to_max_ratio": amt / F.when(px == 0, 1.0).otherwise(px),
        "cust_tx_velocity_1h": F.least(F.col("_c_rn"), F.lit(10)) - 1,
        "cust_tx_velocity_24h": F.least(F.col("_c_rn"), F.lit(50)) - 1,
        "term_tx_velocity_1h": F.least(F.col("_t_rn"), F.lit(10)) - 1,
        "cust_amount_rolling_mean": m10, "cust_amount_deviation_rolling": F.abs(amt - m10) / (m10 + 1e-8),
        "TX_TS_unix": unix_s,
        "cust_prev_tx_time": F.coalesce((unix_s - F.floor(F.col("_c_prev_us") / 1e6)).cast("double"), F.lit(0.0)),
        "term_prev_tx_time": F.coalesce((unix_s - F.floor(F.col("_t_prev_us") / 1e6)).cast("double"), F.lit(0.0)),
        "card_age_days": S.days_to_expiry("CARD_EXPIRY_DATE", "TX_TS"),
        "merchant_age_days": S.merchant_age_days("TX_TS", "FOUNDATION_DATE"),
        "tax_exempt": S.bool_int(S.fuzzy_bool("TAX_EXCEMPT_INDICATOR")),
        "annual_turnover_log": S.log1p0("ANNUAL_TURNOVER"), "avg_ticket_log": S.log1p0("AVERAGE_TICKET_SALE_AMOUNT"),
        "amount_vs_merchant_avg": S.ratio(amt, "AVERAGE_TICKET_SALE_AMOUNT"),
        "tx_to_turnover_ratio": S.ratio(amt, "ANNUAL_TURNOVER_CARD"),
        "cashback_ratio": S.ratio("TRANSACTION_CASHBACK_AMOUNT", amt),
        "goods_ratio": S.ratio("TRANSACTION_GOODS_AND_SERVICES_AMOUNT", amt),
        "is_recurring": S.bool_int(S.fuzzy_bool("IS_RECURRING_TRANSACTION")),
        "is_ron_currency": S.eq_flag("TRANSACTION_CURRENCY", "RON"), "is_ro_country": S.eq_flag("CARD_COUNTRY_CODE", "RO"),
        "no_auth": S.eq_flag("CARDHOLDER_AUTH_METHOD", "No CVM performed"),
        "pin_auth": S.contains_flag("CARDHOLDER_AUTH_METHOD", "PIN"),
        "signature_only": S.eq_flag("CARDHOLDER_AUTH_METHOD", "Signature"),
        "offline_auth": S.contains_flag("CARDHOLDER_AUTH_METHOD", "Offline"),
        "is_refund": S.eq_flag("TRANSACTION_TYPE", "Refund"),
        "is_purchase_cashback": S.eq_flag("TRANSACTION_TYPE", "Purchase with cashback"),
        "is_cash_advance": S.eq_flag("TRANSACTION_TYPE", "Cash Advance/Withdrawal"),
        "is_high_risk_currency": S.in_flag("TRANSACTION_CURRENCY", S.HIGH_RISK_CURRENCIES),
        "is_high_risk_country": S.in_flag("CARD_COUNTRY_CODE", S.HIGH_RISK_COUNTRIES),
        "is_high_risk_acquirer": S.in_flag("ACQUIRER_ID", S.HIGH_RISK_ACQUIRERS),
        "is_high_risk_hour": S.in_flag(h, S.HIGH_RISK_HOURS), "is_low_risk_hour": S.in_flag(h, S.LOW_RISK_HOURS),
        "is_early_morning": ((h >= 3) & (h <= 7)).cast("int"),
        "is_s_corp": S.eq_flag("BUSINESS_TYPE", "S Corporations"),
        "is_llc": S.eq_flag("BUSINESS_TYPE", "Limited Liability Company (LLC)"),
        "is_visa": S.eq_flag("CARD_BRAND", "Visa"), "is_amex": S.eq_flag("CARD_BRAND", "AMEX"),
        "is_ecommerce_only": S.eq_flag("OUTLET_TYPE", "Ecommerce"),
        "is_face_to_face_only": S.eq_flag("OUTLET_TYPE", "Face to Face"),
        "is_mixed_outlet": S.eq_flag("OUTLET_TYPE", "Face to Face and Ecommerce"),
        **{k: v for k, v in S.amount_bands(amt).items()},
        **S.round_flags(amt),
        **S.cashback_features(amt, "TRANSACTION_GOODS_AND_SERVICES_AMOUNT", "TRANSACTION_CASHBACK_AMOUNT"),
        **S.centre_features("x_customer_id", "y_customer_id", "x_terminal_id", "y_terminal_id"),
        **{k: v for k, v in S.merchant_flags("DEPOSIT_REQUIRED_PERCENTAGE", "DEPOSIT_PERCENTAGE", "PAYMENT_PERCENTAGE_ECOM",
                                             "PAYMENT_PERCENTAGE_FACE_TO_FACE", "PAYMENT_PERCENTAGE_MOTO",
                                             "DELIVERY_SAME_DAYS_PERCENTAGE", "DELIVERY_OVER_TWO_WEEKS_PERCENTAGE").items()
           if k in ("merchant_deposit_risk", "deposit_gap", "same_day_delivery", "slow_delivery_risk")},
    }
    for n in (3, 5, 10):
        cols[f"cust_amount_mean_last_{n}"] = F.coalesce(F.col(f"_c_l{n}_mean"), med)
        cols[f"cust_amount_std_last_{n}"] = F.coalesce(F.col(f"_c_l{n}_std"), F.lit(0.0))
        cols[f"cust_tx_count_last_{n}"] = F.when(F.col("_c_rn") < n, F.lit(0)).otherwise(F.least(F.col("_c_rn") - 1, F.lit(n)))
    d = d.withColumns(cols)
    d = d.withColumns({
        "card_near_expiry": (F.col("card_age_days") <= 90).cast("int"),
        "merchant_young": (F.col("merchant_age_days") <= 365).cast("int"),
        "ron_ro_combined": F.col("is_ron_currency") * F.col("is_ro_country"),
        "high_risk_combo": F.col("is_ron_currency") * F.col("is_ro_country") * F.col("is_fraud_amount_range"),
        "ron_ro_high_amount": F.col("is_ron_currency") * F.col("is_ro_country") * F.col("is_fraud_critical_amount"),
        "cashback_no_auth": F.col("has_cashback") * F.col("no_auth"),
        "refund_high_amount": F.col("is_refund") * F.col("is_very_high_amount"),
    })
    keep = ["TX_ID", "TX_TS", "TX_AMOUNT", "CUSTOMER_ID", "MERCHANT_ID", "MCC_CODE", "TERMINAL_ID", "CARD_BRAND",
            "TRANSACTION_CURRENCY", "x_customer_id", "y_customer_id", "is_fraudulent_terminal",
            "amount_percentile_merchant", "mcc_frequency", *cols.keys(), "card_near_expiry", "merchant_young",
            "ron_ro_combined", "high_risk_combo", "ron_ro_high_amount", "cashback_no_auth", "refund_high_amount"]
    if "TX_FRAUD" in d.columns:
        keep.append("TX_FRAUD")
    return d.select(*dict.fromkeys(keep))


# P4's target-encoded categoricals and P5's one-hot ones.
P4_TARGET_CODED = ["CARD_BRAND", "TRANSACTION_TYPE", "TRANSACTION_STATUS", "TRANSACTION_CURRENCY", "CARD_COUNTRY_CODE", "IS_RECURRING_TRANSACTION", "BUSINESS_TYPE", "OUTLET_TYPE"]
P5_ONE_HOT = ["TRANSACTION_TYPE", "TRANSACTION_STATUS", "FAILURE_CODE", "ACQUIRER_ID", "CARD_BRAND", "CARD_COUNTRY_CODE", "TRANSACTION_CURRENCY",
              "CARDHOLDER_AUTH_METHOD", "BUSINESS_TYPE", "OUTLET_TYPE"]


P4_MERCHANT = ["MCC_CODE", "BUSINESS_TYPE", "OUTLET_TYPE", "TAX_EXCEMPT_INDICATOR", "ANNUAL_TURNOVER", "ANNUAL_TURNOVER_CARD", "AVERAGE_TICKET_SALE_AMOUNT", "FOUNDATION_DATE"]


def _p4_rows(df: DataFrame, bad: DataFrame, profiles: dict[str, DataFrame], customers: DataFrame, terminals: DataFrame, merchants: DataFrame) -> DataFrame:
    """P4's row features, the customer's and terminal's own history within ``df`` (a written table) and the
    ``profiles`` of each key: narrow rows go from key to key and meet the wide rows by ``TX_ID``."""
    unix_s, n = S.epoch_s("TX_TS"), df.count()

    def feats(p, who):
        out = {f"{who}_prev_tx_time": F.coalesce((unix_s - F.floor(F.col(f"{p}prev__us") / 1e6)).cast("double"), F.lit(0.0)), f"_{who}_rn": F.col(f"{p}rn")}
        for n in (3, 5, 10):
            total = F.coalesce(F.col(f"{p}l{n - 1}_sum"), F.lit(0.0)) + F.col("TX_AMOUNT")
            out[f"{who}_last{n}_tx_sum"] = total
            if who == "cust":
                out[f"{who}_last{n}_tx_mean"] = total / (F.col(f"{p}l{n - 1}_cnt") + 1)
        return out
    h = df.select("TX_ID", "TX_TS", "CUSTOMER_ID", "TERMINAL_ID", "MERCHANT_ID", "TX_AMOUNT")
    for key, who, dim, keep in (("CUSTOMER_ID", "cust", customers, P3_CUSTOMER), ("TERMINAL_ID", "term", terminals, P3_TERMINAL)):
        seen, p = [c for c in h.columns if c != key], f"_{who[0]}"
        h = W.prior_history(h.repartition(key), [key], last_n=[2, 4, 9], p=p, n_rows=n, keys_of=df)
        h = h.select(key, *seen, *[c.alias(x) for x, c in feats(p, who).items()])
        h = _with_dim(h.join(profiles[key], key, "left"), dim, key, f"_{who}", keep)
        h = (star.membership_flag(h, bad, key, "is_fraudulent_terminal") if who == "term" else h).drop(key)
    h = W.add_rank_pct(h.drop("TX_TS").repartition("MERCHANT_ID"), "TX_AMOUNT", "amount_percentile_merchant", keys=["MERCHANT_ID"], n_rows=n, keys_of=df)
    h = _with_dim(h.join(profiles["MERCHANT_ID"], "MERCHANT_ID", "left"), merchants, "MERCHANT_ID", "_merch", P4_MERCHANT).drop("MERCHANT_ID", "TX_AMOUNT")
    dims = ["_merch", "_cust", "_term"]
    d = _meet(df, h, [*dims, "is_fraudulent_terminal", *[c for x in profiles.values() for c in x.columns]])
    d = star.unpacked(d, dims)
    d = encode.frequency_encode(d, "MCC_CODE", "mcc_frequency",
                                reference=df.select("MERCHANT_ID").join(merchants.select("MERCHANT_ID", "MCC_CODE"), "MERCHANT_ID", "left"))
    h, amt = F.hour("TX_TS"), F.col("TX_AMOUNT")
    dist = S.distance("x_customer_id", "y_customer_id", "x_terminal_id", "y_terminal_id")
    d = d.withColumns({
        "hour": h, "day_of_week": S.weekday("TX_TS"), "is_weekend": S.is_weekend("TX_TS"), "is_night": S.is_night(h), "time_of_day": S.time_of_day("TX_TS"),
        "is_business_hours": S.is_business_hours(h), "tx_hour_risk": S.hour_risk(h), "distance": dist, "distance_tx": dist * amt,
        "cashback_ratio": S.ratio("TRANSACTION_CASHBACK_AMOUNT", amt), "goods_ratio": S.ratio("TRANSACTION_GOODS_AND_SERVICES_AMOUNT", amt),
        **{f"{c}_log": F.log1p(c) for c in ("TX_AMOUNT", "TRANSACTION_GOODS_AND_SERVICES_AMOUNT", "TRANSACTION_CASHBACK_AMOUNT")},
        "tax_exempt": S.bool_int(S.fuzzy_bool("TAX_EXCEMPT_INDICATOR")), "annual_turnover_log": S.log1p0("ANNUAL_TURNOVER"), "avg_ticket_log": S.log1p0("AVERAGE_TICKET_SALE_AMOUNT"),
        "is_recurring": S.bool_int(S.fuzzy_bool("IS_RECURRING_TRANSACTION")), "tx_to_turnover_ratio": S.ratio(amt, "ANNUAL_TURNOVER_CARD"),
        "is_fraud_amount_range": S.amount_bands(amt)["is_fraud_amount_range"], "is_ron_currency": S.eq_flag("TRANSACTION_CURRENCY", "RON"), "is_ro_country": S.eq_flag("CARD_COUNTRY_CODE", "RO"),
        "cust_tx_velocity_1h": F.least(F.col("_cust_rn"), F.lit(10)) - 1, "cust_tx_velocity_24h": F.least(F.col("_cust_rn"), F.lit(50)) - 1,
        "term_tx_velocity_1h": F.least(F.col("_term_rn"), F.lit(10)) - 1, "cust_amount_rolling_mean": F.col("cust_last10_tx_mean"),
        "cust_amount_deviation": F.abs(amt - F.col("cust_last10_tx_mean")) / (F.col("cust_last10_tx_mean") + 1e-8),
        "card_age_days": S.days_to_expiry("CARD_EXPIRY_DATE", "TX_TS"), "merchant_age_days": S.merchant_age_days("TX_TS", "FOUNDATION_DATE"),
        "amount_vs_merchant_avg": S.ratio(amt, "AVERAGE_TICKET_SALE_AMOUNT"), "TX_TS_unix": unix_s,
    })
    ron = F.col("is_ron_currency") * F.col("is_ro_country")
    return d.withColumns({"ron_ro_combined": ron, "high_risk_combo": ron * F.col("is_fraud_amount_range"), "card_near_expiry": (F.col("card_age_days") <= 90).cast("int"),
                          "merchant_young": (F.col("merchant_age_days") <= 365).cast("int")})


def p4_history_and_target_encoding(train: DataFrame, test: DataFrame, customers: DataFrame, terminals: DataFrame, merchants: DataFrame, *, k: int = 5,
                                   alpha: float = 10.0, shuffle_key=None) -> tuple[DataFrame, DataFrame]:
    """Row features, whole-period entity statistics of the training rows, lags, last-n sums and smoothed
    out-of-fold target encodings (B1, D17, C1, H*, E3, E8-E10, E14, D14, D15, C7, I5, J3, I8, I9).

    Nulls are 0 (text ``0``) before the target encoding. Returns ``(train, test)``, each with the id,
    the label and the features; test rows get training statistics.
    """
    from frauddeck.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(train.sparkSession)
    train, test = (written(one_row_per_tx(x)) for x in (train, test))  # read by each block and statistic
    bad = profile.compromised_entities(train, "TERMINAL_ID")
    stats, profiles = [], {}
    for key, who in (("CUSTOMER_ID", "cust"), ("TERMINAL_ID", "term"), ("MERCHANT_ID", "merch")):
        old = key.split("_")[0].lower()
        prof = profile.entity_amount_profile(train, key).join(profile.entity_fraud_profile(train, key), key, "left")
        names = {f"{old}_amt_{x}": f"{who}_tx_{x}" for x in ("count", "mean", "std", "median")} | {f"{old}_fraud_{x}": f"{who}_fraud_{x}" for x in ("rate", "count")}
        if who != "merch":
            names |= {f"{old}_amt_min": f"{old}_min_tx", f"{old}_amt_max": f"{old}_max_tx"}
        profiles[key] = prof.select(key, *[F.col(a).alias(b) for a, b in names.items()]).checkpoint()  # one row for each key, joined twice
        stats += names.values()
    tr, te = (_p4_rows(x, bad, profiles, customers, terminals, merchants) for x in (train, test))
    rows = [c for c in tr.columns if c not in train.columns and c not in stats and c not in customers.columns and c not in terminals.columns and c not in merchants.columns and c[0] != "_"]
    numbers = ["TX_AMOUNT", *rows, *stats]
    zero = lambda d: d.select("TX_ID", "TX_FRAUD", *[F.coalesce(F.col(c), F.lit(0).cast(d.schema[c].dataType)).alias(c) for c in numbers],
                              *[S.null_token(c, "0").alias(c) for c in P4_TARGET_CODED])
    tr, te = zero(tr), zero(te)
    # folds and encodings come from the narrow training rows, cut from their lineage; what is
    # joined to the wide rows is a few rows for each category and fold
    narrow = star.star_join(train.select("TX_ID", "TX_FRAUD", "MERCHANT_ID", *[c for c in P4_TARGET_CODED if c in train.columns]),
                            merchants=merchants.select("MERCHANT_ID", *[c for c in P4_TARGET_CODED if c in merchants.columns]))
    narrow = narrow.select("TX_ID", "TX_FRAUD", *[S.null_token(c, "0").alias(c) for c in P4_TARGET_CODED])
    narrow = split.stratified_kfold(narrow, k, shuffle_key=shuffle_key).checkpoint()
    g = float(narrow.agg(F.avg("TX_FRAUD")).first()[0] or 0.0)
    tr = tr.join(narrow.select("TX_ID", "fold"), "TX_ID")
    for c, table in encode.out_of_fold_tables(narrow, P4_TARGET_CODED, alpha=alpha).items():
        tr = tr.join(table.drop("_n"), [c, "fold"], "left")
        mean = table.groupBy(c).agg((F.sum(F.col(f"{c}_te") * F.col("_n")) / F.sum("_n")).alias(f"{c}_te"))
        te = te.join(mean, c, "left").withColumn(f"{c}_te", F.coalesce(F.col(f"{c}_te"), F.lit(g)))
    return tr.drop("fold"), te


def p5_neural_net_matrix(tx: DataFrame, customers: DataFrame, terminals: DataFrame, merchants: DataFrame, *, shuffle_key=None) -> DataFrame:
    """P5: the numeric matrix with ``TX_ID``, label and ``is_train`` (B1, C1, H*, I5, I1, J1, I10): weekday and
    categorical one-hots, time of day, engineered features, and raw amounts and coordinates that are
    standardised by the training rows."""
    tx = one_row_per_tx(tx)
    d = star.star_join(tx, customers, terminals, merchants)
    h = F.hour("TX_TS")
    d = encode.frequency_encode(d, "MCC_CODE", "mcc_frequency",
                                reference=tx.select("MERCHANT_ID").join(merchants.select("MERCHANT_ID", "MCC_CODE"), "MERCHANT_ID", "left"))
    engineered = {
        "time_of_day": S.time_of_day("TX_TS"), "amount_log": F.log1p("TX_AMOUNT"), "cashback_ratio": S.ratio("TRANSACTION_CASHBACK_AMOUNT", "TX_AMOUNT"),
        "goods_ratio": S.ratio("TRANSACTION_GOODS_AND_SERVICES_AMOUNT", "TX_AMOUNT"), "is_weekend": S.is_weekend("TX_TS"), "is_night": S.is_night(h),
        "distance": S.distance("x_customer_id", "y_customer_id", "x_terminal_id", "y_terminal_id"), "tax_exempt": S.bool_int(S.fuzzy_bool("TAX_EXCEMPT_INDICATOR")),
        "annual_turnover_log": S.log1p0("ANNUAL_TURNOVER"), "avg_ticket_log": S.log1p0("AVERAGE_TICKET_SALE_AMOUNT"), "mcc_frequency": F.col("mcc_frequency"),
        "is_recurring": S.bool_int(S.fuzzy_bool("IS_RECURRING_TRANSACTION"))}
    raw = ["TX_AMOUNT", "TRANSACTION_GOODS_AND_SERVICES_AMOUNT", "TRANSACTION_CASHBACK_AMOUNT", "x_customer_id", "y_customer_id", "x_terminal_id", "y_terminal_id"]
    # levels come from the narrow columns, all in one job
    narrow = star.star_join(tx.select("MERCHANT_ID", S.weekday("TX_TS").cast("string").alias("dow"), *[c for c in P5_ONE_HOT if c in tx.columns]),
                            merchants=merchants.select("MERCHANT_ID", *[c for c in P5_ONE_HOT if c in merchants.columns]))
    hot = [c for c in P5_ONE_HOT if c in narrow.columns]
    d = d.select("TX_ID", "TX_FRAUD", *raw, *hot, S.weekday("TX_TS").cast("string").alias("dow"), *[c.cast("double").alias(n) for n, c in engineered.items()])
    d = encode.one_hot(d, ["dow", *hot], levels_from=narrow)
    d = split.stratified_split(d, shuffle_key=shuffle_key)
    return encode.standard_scale(d, raw, fit_on=d.filter(F.col("is_train") == 1))


def p6_profiling_pack(df: DataFrame) -> dict:
    """The profiling reports over one star-joined, flagged fact table, as functions: a report's
    jobs start when it is called."""
    h = F.hour("TX_TS")
    return {
        "overall": lambda: profile.overall_rate(df),
        "by_hour": lambda: profile.rate_by(df, {"hour": h}),
        "by_weekday": lambda: profile.rate_by(df, {"weekday": S.weekday("TX_TS")}),
        "by_brand": lambda: profile.rate_by(df, "CARD_BRAND"),
        "by_mcc_top20": lambda: profile.rate_by(df, "MCC_CODE", min_count=100, top=20),
        "by_terminal_top20": lambda: profile.rate_by(df, "TERMINAL_ID", min_count=50, top=20),
        "amount_bands": lambda: profile.rate_by_bins(df, "TX_AMOUNT", profile.AMOUNT_EDGES, profile.AMOUNT_LABELS, "amount_bin"),
        "amount_buckets": lambda: profile.amount_buckets(df),
        "histogram": lambda: profile.histogram(df, "TX_AMOUNT", 50, by="TX_FRAUD"),
        "summary": lambda: profile.dataset_summary(df),
    }


def p7_customer_behaviour(tx: DataFrame) -> DataFrame:
    """Customer-behaviour features of star-joined rows.

    Numeric features with nulls get their median, categoricals are text with a null token.
    """
    tx = one_row_per_tx(tx)
    median = exact_quantile(tx, "TX_AMOUNT", 0.5).select(F.col("q_TX_AMOUNT").alias("_median"))
    bc = W.history_block(tx, ["CUSTOMER_ID"], lambda h: {
        "_crn": F.col("_crn"), "_cprev__us": F.col("_cprev__us"), "_pm": W.prior_mean("_c"), "_ps": W.prior_std("_c"),
        "_cmax": F.col("_cmax"), **{f"_m{n}": W.lastn_mean(n, "_c") for n in (3, 5, 10)}}, last_n=[3, 5, 10], p="_c")
    bm = W.history_block(tx, ["CUSTOMER_ID", "MERCHANT_ID"], {"_mrn": F.col("_mrn"), "_mprev__us": F.col("_mprev__us")},
                         value=None, p="_m")
    d = attach_row(tx.join(bc, "TX_ID", "left").join(bm, "TX_ID", "left"), median)
    amt, med, us = F.col("TX_AMOUNT"), F.col("_median"), S.epoch_us("TX_TS")
    pm = F.coalesce(F.col("_pm"), med)
    ps = F.coalesce(F.col("_ps"), F.lit(0.0))
    px = F.coalesce(F.col("_cmax"), med)
    gap = F.coalesce((us - F.col("_cprev__us")) / 1e6, F.lit(86400.0))
    raw = S.expiry_parts_raw("CARD_EXPIRY_DATE")
    cols = {"hour": F.hour("TX_TS"), "day_of_week": S.weekday("TX_TS"), "day_of_month": F.dayofmonth("TX_TS"),
            "month": F.month("TX_TS"), "is_weekend": S.is_weekend("TX_TS"), "is_night": S.is_night(F.hour("TX_TS")),
            "time_since_last_tx": gap, "cust_tx_count": F.col("_crn"),
            "cust_avg_amount": pm, "cust_std_amount": ps, "cust_max_amount": px,
            "amount_deviation": F.coalesce((amt - pm) / F.when(ps == 0, 1.0).otherwise(ps), F.lit(0.0)),
            "amount_to_max_ratio": amt / F.when(px == 0, 1.0).otherwise(px),
            "is_high_amount": (amt > pm * 3).cast("int"),
            "time_since_last_tx_merchant": F.coalesce((us - F.col("_mprev__us")) / 1e6, F.lit(86400.0 * 30)),
            "cust_merchant_tx_count": F.col("_mrn") - 1,
            **raw, "activity_intensity": F.col("_crn") / (gap / 3600 + 1)}
    for n in (3, 5, 10):
        cols[f"amount_mean_last_{n}"] = F.coalesce(F.col(f"_m{n}"), med)
        cols[f"tx_count_last_{n}"] = F.least(F.col("_crn") - 1, F.lit(n))
    d = d.withColumns(cols)
    numeric = ["TX_AMOUNT", *cols, *[c for c in ("x_customer_id", "y_customer_id") if c in d.columns]]
    cats = [c for c in P7_CATEGORICALS if c in d.columns]
    d = clean.null_tokens(d.withColumns({c: F.col(c).cast("string") for c in cats}), cats, "MISSING")
    gaps = d.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in numeric]).first()
    d = d.select("TX_ID", *[c for c in ("TX_FRAUD",) if c in d.columns], *numeric, *cats)
    with_gaps = [c for c in numeric if gaps[c]]
    return clean.impute_median(d.withColumns({c: F.col(c).cast("double") for c in with_gaps}), with_gaps) if with_gaps else d


# P7's categorical features; P12's label-coded columns and features.
P7_CATEGORICALS = ["CUSTOMER_ID", "TERMINAL_ID", "CARD_BRAND", "TRANSACTION_TYPE", "TRANSACTION_STATUS", "TRANSACTION_CURRENCY", "CARD_COUNTRY_CODE",
                   "MERCHANT_ID", "CARDHOLDER_AUTH_METHOD", "ACQUIRER_ID", "BUSINESS_TYPE", "OUTLET_TYPE", "MCC_CODE"]
P12_CODES = ["CARD_BRAND", "TRANSACTION_TYPE", "TRANSACTION_STATUS", "CARDHOLDER_AUTH_METHOD", "BUSINESS_TYPE", "OUTLET_TYPE", "card_first_digits", "card_last_digits"]
P12_FEATURES = ["TX_AMOUNT", "hour", "day_of_week", "day_of_month", "month", "time_since_last_tx", "amount_to_avg_ratio", "x_customer_id", "y_customer_id",
                "MCC_CODE", "ANNUAL_TURNOVER", "AVERAGE_TICKET_SALE_AMOUNT", *P12_CODES, "card_expiry_year", "card_expiry_month"]


def p12_small_booster_table(tx: DataFrame, customers: DataFrame, merchants: DataFrame) -> DataFrame:
    """Small booster table (B1, C1, E1, E16, H2, H11, H24, I3): its feature list with the id and label.

    Label codes are those of the sorted text values (a null is the text ``nan``).
    """
    tx = one_row_per_tx(tx)
    block = W.history_block(tx, ["CUSTOMER_ID"], {"time_since_last_tx": F.coalesce(W.seconds_since_prev(), F.lit(0.0))}, value=None)
    d = W.add_entity_stats(tx.join(block, "TX_ID", "left"), "CUSTOMER_ID", "TX_AMOUNT", {"_cust_mean": "mean"})
    pan = S.pan_parts("CARD_DATA")
    d = star.star_join(d, customers, None, merchants).withColumns({
        "hour": F.hour("TX_TS"), "day_of_week": S.weekday("TX_TS"), "day_of_month": F.dayofmonth("TX_TS"), "month": F.month("TX_TS"),
        "amount_to_avg_ratio": F.col("TX_AMOUNT") / F.col("_cust_mean"),
        "card_expiry_month": S.split_part("CARD_EXPIRY_DATE", "/", 0).try_cast("int"),
        "card_expiry_year": S.split_part("CARD_EXPIRY_DATE", "/", 1).try_cast("int"),
        "card_first_digits": pan["card_bin4"], "card_last_digits": pan["card_last4"]})
    base = star.star_join(tx.select("MERCHANT_ID", "CARD_BRAND", "TRANSACTION_TYPE", "TRANSACTION_STATUS", "CARDHOLDER_AUTH_METHOD",
                                    pan["card_bin4"].alias("card_first_digits"), pan["card_last4"].alias("card_last_digits")),
                          merchants=merchants.select("MERCHANT_ID", "BUSINESS_TYPE", "OUTLET_TYPE"))
    for c in P12_CODES:
        d = encode.apply_codes(d, c, encode.fit_codes(base, c, null_token="nan"), unseen="first", null_token="nan")
    return d.select("TX_ID", *[c for c in ("TX_FRAUD",) if c in d.columns], *P12_FEATURES)


def time_split_features(tx: DataFrame, customers: DataFrame, terminals: DataFrame, merchants: DataFrame) -> DataFrame:
    """P3 with ``is_train`` (J2): rows are split first, and what is fitted (flagged terminals, the
    median, category shares) comes from the training rows alone, so no scored row sees its label."""
    from frauddeck.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(tx.sparkSession)
    tx = one_row_per_tx(tx)
    parts = split.time_split(tx.select("TX_ID", "TX_TS")).select("TX_ID", "is_train").checkpoint()
    train = tx.join(parts.where("is_train = 1").select("TX_ID"), "TX_ID", "left_semi")
    return p3_unified_features(tx, customers, terminals, merchants, label_source=train, reference=train).join(parts, "TX_ID")


def p8_train_score_submit(features: DataFrame, test: DataFrame, feature_cols: list[str], *, k: int = 5,
                          label: str = "TX_FRAUD", override_flag: str | None = "is_fraudulent_terminal",
                          settings=None, shuffle_key=None, progress=None) -> dict[str, DataFrame]:
    """Stratified folds, out-of-fold leaf-wise booster scores, fold-mean test scores, rule override,
    OOF ROC-AUC and average precision (J3, K1, K5, K7, L5, L7).

    Each fold's held-out rows stop its boosting by average precision. ``progress`` (a
    :class:`frauddeck.sources.io.FoldProgress`) keeps finished folds, so that a run that died goes on
    with the next one.
    """
    from frauddeck.operators import leafwise, metrics, ml
    if override_flag and override_flag not in test.columns:
        raise KeyError(f"{override_flag}: the rule override was asked for, but the test rows lack its flag")
    f = written(split.stratified_kfold(features, k, shuffle_key=shuffle_key))  # read by every fold

    def fit(train: DataFrame, held: DataFrame):
        both = train.withColumn("_valid", F.lit(False)).unionByName(held.withColumn("_valid", F.lit(True)))
        return leafwise.fit(both, feature_cols, label, valid="_valid", settings=settings or leafwise.Settings())
    oof, test_scores = ml.kfold_oof(f, test, feature_cols, label, k=k, fit=fit, progress=progress, parallelism=k)
    ev = oof.join(features.select("TX_ID", F.col(label).alias("y")), "TX_ID")
    if override_flag:
        test_scores = ml.override_known_bad(test_scores.join(test.select("TX_ID", override_flag), "TX_ID"),
                                            override_flag).drop(override_flag)
    return {"oof": oof, "submission": test_scores,
            "auc": lambda: metrics.roc_auc(ev, "oof", "y"), "ap": lambda: metrics.average_precision(ev, "oof", "y")}


def p9_blend_and_compare(a: DataFrame, b: DataFrame) -> dict:
    """Align two score files, blend them several ways, compare them (C4, M*, L12, L13); functions."""
    from frauddeck.operators import blend as M, metrics
    j = star.align_scores(a, b).withColumnRenamed("TX_FRAUD_a", "p_a").withColumnRenamed("TX_FRAUD_b", "p_b")
    c = j.select("TX_ID", M.clip_probs("p_a").alias("p_a"), M.clip_probs("p_b").alias("p_b"))
    return {"blends": lambda: c.select("TX_ID", M.weighted_mean("p_a", "p_b").alias("weighted"),
                                       M.geometric_mean("p_a", "p_b", 0.62).alias("geometric"),
                                       M.logit_blend("p_a", "p_b").alias("logit"), M.entropy_weighted("p_a", "p_b").alias("entropy")),
            "agreement": lambda: metrics.agreement(j), "grades": lambda: metrics.grades(metrics.agreement(j), keep=True)}


def p10_spatial_risk(tx: DataFrame, customers: DataFrame, terminals: DataFrame) -> dict:
    """P10: cell fraud rates on both grids, regression surfaces, per-row risk (D17, D18, K8, H13);
    functions: cells train nothing, the grid fits one surface, the rows both."""
    from frauddeck.operators import ml
    from frauddeck.session import ensure_checkpoint_dir
    j = star.star_join(tx, customers, terminals)

    def customer_cells():
        return profile.spatial_cells(j.withColumns({"cx": F.round("x_customer_id"), "cy": F.round("y_customer_id")}), "cx", "cy")

    def terminal_cells():
        return profile.spatial_cells(j.withColumns({"tx_": F.round("x_terminal_id"), "ty": F.round("y_terminal_id")}),
                                     "tx_", "ty", exclude=profile.compromised_entities(tx, "TERMINAL_ID"), key="TERMINAL_ID")

    def surface(cells, x, y):
        ensure_checkpoint_dir(tx.sparkSession)
        return ml.fit_spatial_surface(cells.checkpoint(), x, y)  # a fit reads its cells many times

    def rows():
        r = ml.apply_spatial_surface(surface(customer_cells(), "cx", "cy"), j, "x_customer_id", "y_customer_id", "customer_area_risk")
        r = ml.apply_spatial_surface(surface(terminal_cells(), "tx_", "ty"), r, "x_terminal_id", "y_terminal_id", "terminal_area_risk")
        return r.withColumn("combined_area_risk", F.col("customer_area_risk") + F.col("terminal_area_risk"))
    return {"customer_cells": customer_cells, "terminal_cells": terminal_cells, "rows": rows,
            "grid": lambda: ml.score_grid(tx.sparkSession, surface(customer_cells(), "cx", "cy"))}


def p11_score_report(scored: DataFrame, score: str = "TX_FRAUD", threshold: float = 0.5) -> dict:
    """Score histogram, describe, top-5% cutoff, mean score by hour/type/brand,
    prediction summary, top-10 rows (D12, D22-D26, F4), as functions."""
    s = scored.withColumn("pred", (F.col(score) >= threshold).cast("int"))
    return {"histogram": lambda: profile.histogram(s, score, 30), "describe": lambda: profile.describe(s, score),
            "top5pct": lambda: profile.percentile_flag(s, score, 0.95),
            "by_hour": lambda: profile.mean_by(s, {"hour": F.hour("TX_TS")}, score),
            "by_type": lambda: profile.mean_by(s, "TRANSACTION_TYPE", score),
            "by_brand": lambda: profile.mean_by(s, "CARD_BRAND", score),
            "summary": lambda: profile.prediction_summary(s, "pred"), "moments": lambda: profile.score_moments(s, score),
            "top10": lambda: profile.top_n(s, [F.col(score).desc(), F.col("TX_ID")], 10)}
