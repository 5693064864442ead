"""Registered queries: scalar feature functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from frauddeck.functions import scalars as S
from frauddeck.plans.catalog import query
from frauddeck.plans.common import joined, r, tx

STAR = ("tx LEFT JOIN merchants USING (MERCHANT_ID) LEFT JOIN customers USING (CUSTOMER_ID) "
        "LEFT JOIN terminals USING (TERMINAL_ID)")


@query("h1_h12_calendar_features", """
SELECT TX_ID, CAST(hour(TX_TS) AS BIGINT) AS hour, CAST(isodow(TX_TS) - 1 AS BIGINT) AS dayofweek,
  CAST(day(TX_TS) AS BIGINT) AS day_of_month, CAST(month(TX_TS) AS BIGINT) AS month,
  ROUND((hour(TX_TS) * 3600 + minute(TX_TS) * 60 + floor(second(TX_TS))) / 86400.0, 9) AS time_of_day,
  CAST(isodow(TX_TS) - 1 IN (5, 6) AS INTEGER) AS is_weekend,
  CAST(hour(TX_TS) >= 22 OR hour(TX_TS) <= 6 AS INTEGER) AS is_night,
  CAST(hour(TX_TS) >= 9 AND hour(TX_TS) <= 17 AS INTEGER) AS is_business_hours,
  CAST(hour(TX_TS) BETWEEN 3 AND 7 AS INTEGER) AS is_early_morning,
  CAST(hour(TX_TS) >= 23 OR hour(TX_TS) <= 2 AS INTEGER) AS is_late_night,
  CAST(hour(TX_TS) BETWEEN 11 AND 14 AS INTEGER) AS is_lunch_time,
  CAST(hour(TX_TS) BETWEEN 7 AND 9 OR hour(TX_TS) BETWEEN 17 AND 19 AS INTEGER) AS is_rush_hour,
  CAST(day(TX_TS) <= 3 AS INTEGER) AS is_month_start, CAST(day(TX_TS) >= 28 AS INTEGER) AS is_month_end,
  CAST([3,3,3,3,2,1,1,1,1,0,0,0,0,0,0,0,0,0,1,1,1,2,2,3][hour(TX_TS) + 1] AS INTEGER) AS tx_hour_risk,
  CAST(hour(TX_TS) IN (4, 8, 10, 11, 18) AS INTEGER) AS is_high_risk_hour,
  CAST(hour(TX_TS) IN (12, 20, 23) AS INTEGER) AS is_low_risk_hour
FROM tx""")
def h1_h12_calendar_features(spark, sf):
    """H2-H7 calendar parts, day fraction, weekend/night/business hours, bands, hour risk, risk-hour sets."""
    t = tx(spark, sf)
    h = F.hour("TX_TS")
    bands = S.hour_bands(h, F.dayofmonth("TX_TS"))
    return t.select(
        "TX_ID", h.cast("bigint").alias("hour"), S.weekday("TX_TS").cast("bigint").alias("dayofweek"),
        F.dayofmonth("TX_TS").cast("bigint").alias("day_of_month"), F.month("TX_TS").cast("bigint").alias("month"),
        r(S.time_of_day("TX_TS"), 9).alias("time_of_day"), S.is_weekend("TX_TS").alias("is_weekend"),
        S.is_night(h).alias("is_night"), S.is_business_hours(h).alias("is_business_hours"),
        *[c.alias(n) for n, c in bands.items()],
        S.hour_risk(h).alias("tx_hour_risk"), S.in_flag(h, S.HIGH_RISK_HOURS).alias("is_high_risk_hour"),
        S.in_flag(h, S.LOW_RISK_HOURS).alias("is_low_risk_hour"))


@query("h8_h12_card_and_merchant_age", """
WITH b AS (SELECT TX_ID, TX_TS, CARD_EXPIRY_DATE, FOUNDATION_DATE,
  TRY_CAST(split_part(CARD_EXPIRY_DATE, '/', 1) AS INTEGER) AS em,
  TRY_CAST(split_part(CARD_EXPIRY_DATE, '/', 2) AS INTEGER) + 2000 AS ey
  FROM tx LEFT JOIN merchants USING (MERCHANT_ID)),
c AS (SELECT *, CASE WHEN em BETWEEN 1 AND 12 THEN make_date(ey, em, 28) END AS exp28,
  CASE WHEN em BETWEEN 1 AND 12 THEN make_date(ey, em, 1) END AS exp1 FROM b)
SELECT TX_ID, ROUND((year(exp28) - year(TX_TS)) * 12 + (month(exp28) - month(TX_TS)) + (day(exp28) - day(TX_TS)) / 30.0, 6)
    AS months_to_expiry,
  COALESCE(CAST(floor((epoch_us(CAST(exp1 AS TIMESTAMP)) - epoch_us(TX_TS)) / 86400000000.0) AS BIGINT), 365) AS card_age_days,
  CAST(COALESCE(CAST(floor((epoch_us(CAST(exp1 AS TIMESTAMP)) - epoch_us(TX_TS)) / 86400000000.0) AS BIGINT), 365) <= 90 AS INTEGER)
    AS card_near_expiry,
  em AS card_expiry_month, ey AS card_expiry_year, 2024 - ey AS card_age,
  COALESCE(CAST(floor((epoch_us(TX_TS) - epoch_us(CAST(FOUNDATION_DATE AS TIMESTAMP))) / 86400000000.0) AS BIGINT), 1000)
    AS merchant_age_days,
  CAST(COALESCE(CAST(floor((epoch_us(TX_TS) - epoch_us(CAST(FOUNDATION_DATE AS TIMESTAMP))) / 86400000000.0) AS BIGINT), 1000)
    <= 365 AS INTEGER) AS merchant_young
FROM c""")
def h8_h12_card_and_merchant_age(spark, sf):
    j = joined(spark, sf)
    raw = S.expiry_parts_raw("CARD_EXPIRY_DATE")
    m, y = raw["card_expiry_month"], raw["card_expiry_year"]
    valid = m.between(1, 12)
    exp28 = F.when(valid, S.expiry_date28(m, y))
    age = S.days_to_expiry("CARD_EXPIRY_DATE", "TX_TS")
    mage = S.merchant_age_days("TX_TS", "FOUNDATION_DATE")
    return j.select("TX_ID", r(S.months_between30("TX_TS", exp28)).alias("months_to_expiry"),
                    age.alias("card_age_days"), (age <= 90).cast("int").alias("card_near_expiry"),
                    m.alias("card_expiry_month"), y.alias("card_expiry_year"), raw["card_age"].alias("card_age"),
                    mage.alias("merchant_age_days"), (mage <= 365).cast("int").alias("merchant_young"))


@query("h13_h23_math_features", f"""
SELECT TX_ID,
  ROUND(COALESCE(sqrt(pow(x_customer_id - x_terminal_id, 2) + pow(y_customer_id - y_terminal_id, 2)), 0), 6) AS distance,
  ROUND(sqrt(pow(x_customer_id - 50, 2) + pow(y_customer_id - 50, 2)), 6) AS distance_from_center_cust,
  ROUND(sqrt(pow(x_terminal_id - 50, 2) + pow(y_terminal_id - 50, 2)), 6) AS distance_from_center_term,
  COALESCE(CAST(x_customer_id > 25 AND x_customer_id < 75 AND y_customer_id > 25 AND y_customer_id < 75 AS INTEGER), 0) AS customer_in_center,
  COALESCE(CAST(x_terminal_id > 25 AND x_terminal_id < 75 AND y_terminal_id > 25 AND y_terminal_id < 75 AS INTEGER), 0) AS terminal_in_center,
  COALESCE(CAST(x_customer_id > 25 AND x_customer_id < 75 AND y_customer_id > 25 AND y_customer_id < 75 AS INTEGER)
   * CAST(x_terminal_id > 25 AND x_terminal_id < 75 AND y_terminal_id > 25 AND y_terminal_id < 75 AS INTEGER), 0) AS both_in_center,
  CAST((CASE WHEN x_customer_id >= 50 THEN 2 ELSE 0 END + CASE WHEN y_customer_id >= 50 THEN 1 ELSE 0 END)
     = (CASE WHEN x_terminal_id >= 50 THEN 2 ELSE 0 END + CASE WHEN y_terminal_id >= 50 THEN 1 ELSE 0 END) AS INTEGER) AS same_quadrant,
  ROUND(COALESCE(sqrt(pow(x_customer_id - x_terminal_id, 2) + pow(y_customer_id - y_terminal_id, 2)), 0) * TX_AMOUNT, 6) AS distance_tx,
  ROUND(ln(1 + GREATEST(COALESCE(TX_AMOUNT, 0), 0)), 6) AS TX_AMOUNT_log,
  ROUND(ln(1 + GREATEST(COALESCE(ANNUAL_TURNOVER, 0), 0)), 6) AS annual_turnover_log,
  ROUND(TRANSACTION_CASHBACK_AMOUNT / (TX_AMOUNT + 1e-8), 6) AS cashback_ratio,
  ROUND(TRANSACTION_GOODS_AND_SERVICES_AMOUNT / (TX_AMOUNT + 1e-8), 6) AS goods_ratio,
  ROUND(TX_AMOUNT / (AVERAGE_TICKET_SALE_AMOUNT + 1e-8), 6) AS amount_vs_merchant_avg,
  ROUND(TX_AMOUNT / (ANNUAL_TURNOVER_CARD + 1e-8), 9) AS tx_to_turnover_ratio,
  CAST(fmod(TX_AMOUNT, 10) = 0 AS INTEGER) AS is_round_amount, CAST(fmod(TX_AMOUNT, 100) = 0 AS INTEGER) AS is_very_round_amount,
  CAST(fmod(TX_AMOUNT, 1) <> 0 AS INTEGER) AS amount_has_cents,
  COALESCE(CAST(TX_AMOUNT < 10 AS INTEGER), 0) AS is_small_amount, COALESCE(CAST(TX_AMOUNT > 1000 AS INTEGER), 0) AS is_large_amount,
  COALESCE(CAST(TX_AMOUNT >= 50 AND TX_AMOUNT <= 200 AS INTEGER), 0) AS is_medium_amount,
  COALESCE(CAST(TX_AMOUNT >= 100 AND TX_AMOUNT < 200 AS INTEGER), 0) AS is_medium_high_amount,
  COALESCE(CAST(TX_AMOUNT >= 200 AS INTEGER), 0) AS is_very_high_amount,
  COALESCE(CAST(TX_AMOUNT >= 100 AND TX_AMOUNT <= 500 AS INTEGER), 0) AS is_fraud_critical_amount,
  COALESCE(CAST(TX_AMOUNT >= 500 AND TX_AMOUNT <= 1000 AS INTEGER), 0) AS is_fraud_amount_range,
  CASE WHEN TX_AMOUNT >= 500 AND TX_AMOUNT <= 1000 THEN 2.0 ELSE 1.0 END AS sample_weight,
  COALESCE(CAST(TRANSACTION_CASHBACK_AMOUNT > 0 AS INTEGER), 0) AS has_cashback,
  COALESCE(CAST(TRANSACTION_CASHBACK_AMOUNT / (TX_AMOUNT + 1e-8) > 0.1 AS INTEGER), 0) AS high_cashback_ratio,
  ROUND(ln(1 + TRANSACTION_CASHBACK_AMOUNT), 6) AS cashback_amount_log,
  COALESCE(CAST(abs(TRANSACTION_GOODS_AND_SERVICES_AMOUNT - TX_AMOUNT) > 1 AS INTEGER), 0) AS goods_vs_total_mismatch,
  COALESCE(CAST(DEPOSIT_REQUIRED_PERCENTAGE > DEPOSIT_PERCENTAGE AS INTEGER), 0) AS merchant_deposit_risk,
  DEPOSIT_REQUIRED_PERCENTAGE - DEPOSIT_PERCENTAGE AS deposit_gap,
  COALESCE(CAST(PAYMENT_PERCENTAGE_ECOM > 50 AS INTEGER), 0) AS high_ecom,
  COALESCE(CAST(PAYMENT_PERCENTAGE_FACE_TO_FACE > 80 AS INTEGER), 0) AS high_face_to_face,
  COALESCE(CAST(PAYMENT_PERCENTAGE_MOTO > 20 AS INTEGER), 0) AS high_moto,
  COALESCE(CAST(DELIVERY_SAME_DAYS_PERCENTAGE > 50 AS INTEGER), 0) AS same_day_delivery,
  COALESCE(CAST(DELIVERY_OVER_TWO_WEEKS_PERCENTAGE > 30 AS INTEGER), 0) AS slow_delivery_risk,
  ROUND(ln(LEAST(GREATEST(TX_AMOUNT / (TX_AMOUNT + 50.0), 1e-8), 1 - 1e-8) / (1 - LEAST(GREATEST(TX_AMOUNT / (TX_AMOUNT + 50.0), 1e-8), 1 - 1e-8))), 6) AS amount_logit,
  ROUND(1 / (1 + exp(-(TX_AMOUNT / 100.0))), 6) AS amount_sigmoid,
  ROUND(-(TX_AMOUNT / (TX_AMOUNT + 50.0) * ln(TX_AMOUNT / (TX_AMOUNT + 50.0) + 1e-8)
         + (1 - TX_AMOUNT / (TX_AMOUNT + 50.0)) * ln(1 - TX_AMOUNT / (TX_AMOUNT + 50.0) + 1e-8)), 6) AS amount_entropy
FROM {STAR}""")
def h13_h23_math_features(spark, sf):
    """H13-H23 distances, centre box, logs, ratios, round flags, amount bands, cashback, merchant flags."""
    j = joined(spark, sf)
    xc, yc, xt, yt = "x_customer_id", "y_customer_id", "x_terminal_id", "y_terminal_id"
    dist = S.distance(xc, yc, xt, yt, null_to_zero=True)
    cen = S.centre_features(xc, yc, xt, yt)
    rf = S.round_flags("TX_AMOUNT")
    bands = S.amount_bands("TX_AMOUNT")
    cb = S.cashback_features("TX_AMOUNT", "TRANSACTION_GOODS_AND_SERVICES_AMOUNT", "TRANSACTION_CASHBACK_AMOUNT")
    mf = S.merchant_flags("DEPOSIT_REQUIRED_PERCENTAGE", "DEPOSIT_PERCENTAGE", "PAYMENT_PERCENTAGE_ECOM",
                          "PAYMENT_PERCENTAGE_FACE_TO_FACE", "PAYMENT_PERCENTAGE_MOTO",
                          "DELIVERY_SAME_DAYS_PERCENTAGE", "DELIVERY_OVER_TWO_WEEKS_PERCENTAGE")
    p = F.col("TX_AMOUNT") / (F.col("TX_AMOUNT") + 50.0)
    return j.select(
        "TX_ID", r(dist).alias("distance"),
        r(cen["distance_from_center_cust"]).alias("distance_from_center_cust"),
        r(cen["distance_from_center_term"]).alias("distance_from_center_term"),
        cen["customer_in_center"].alias("customer_in_center"), cen["terminal_in_center"].alias("terminal_in_center"),
        cen["both_in_center"].alias("both_in_center"), S.same_quadrant(xc, yc, xt, yt).alias("same_quadrant"),
        r(dist * F.col("TX_AMOUNT")).alias("distance_tx"), r(S.log1p0("TX_AMOUNT")).alias("TX_AMOUNT_log"),
        r(S.log1p0("ANNUAL_TURNOVER")).alias("annual_turnover_log"),
        r(S.ratio("TRANSACTION_CASHBACK_AMOUNT", "TX_AMOUNT")).alias("cashback_ratio"),
        r(S.ratio("TRANSACTION_GOODS_AND_SERVICES_AMOUNT", "TX_AMOUNT")).alias("goods_ratio"),
        r(S.ratio("TX_AMOUNT", "AVERAGE_TICKET_SALE_AMOUNT")).alias("amount_vs_merchant_avg"),
        r(S.ratio("TX_AMOUNT", "ANNUAL_TURNOVER_CARD"), 9).alias("tx_to_turnover_ratio"),
        *[c.alias(n) for n, c in rf.items()],
        *[bands[n].alias(n) for n in ["is_small_amount", "is_large_amount", "is_medium_amount", "is_medium_high_amount",
                                      "is_very_high_amount", "is_fraud_critical_amount", "is_fraud_amount_range"]],
        S.band_weight("TX_AMOUNT").alias("sample_weight"),
        cb["has_cashback"].alias("has_cashback"), cb["high_cashback_ratio"].alias("high_cashback_ratio"),
        r(cb["cashback_amount_log"]).alias("cashback_amount_log"),
        cb["goods_vs_total_mismatch"].alias("goods_vs_total_mismatch"),
        *[c.alias(n) for n, c in mf.items()],
        r(S.logit(p)).alias("amount_logit"), r(S.sigmoid(F.col("TX_AMOUNT") / 100.0)).alias("amount_sigmoid"),
        r(S.binary_entropy(p)).alias("amount_entropy"))


@query("h24_h33_string_flags", f"""
SELECT TX_ID, substr(CARD_DATA, 1, 1) AS card_first_digit, substr(CARD_DATA, 1, 4) AS card_bin4, right(CARD_DATA, 4) AS card_last4,
  CASE substr(CARD_DATA, 1, 1) WHEN '3' THEN 'amex' WHEN '4' THEN 'visa' WHEN '5' THEN 'mastercard' WHEN '6' THEN 'discover'
    ELSE 'other' END AS card_issuer,
  split_part(CARD_EXPIRY_DATE, '/', 2) AS expiry_yy,
  COALESCE(CAST(contains(CARDHOLDER_AUTH_METHOD, 'PIN') AS INTEGER), 0) AS pin_auth,
  COALESCE(CAST(contains(CARDHOLDER_AUTH_METHOD, 'Offline') AS INTEGER), 0) AS offline_auth,
  COALESCE(CAST(CARDHOLDER_AUTH_METHOD = 'No CVM performed' AS INTEGER), 0) AS no_auth,
  COALESCE(CAST(CARDHOLDER_AUTH_METHOD = 'Signature' AS INTEGER), 0) AS signature_only,
  COALESCE(CAST(CARD_BRAND = 'Visa' AS INTEGER), 0) AS is_visa, COALESCE(CAST(CARD_BRAND = 'AMEX' AS INTEGER), 0) AS is_amex,
  COALESCE(CAST(CARD_BRAND = 'Discover' AS INTEGER), 0) AS is_discover,
  COALESCE(CAST(TRANSACTION_STATUS = 'Rejected' AS INTEGER), 0) AS is_rejected,
  COALESCE(CAST(TRANSACTION_STATUS = 'Authorized' AS INTEGER), 0) AS is_authorized,
  COALESCE(CAST(TRANSACTION_TYPE = 'Refund' AS INTEGER), 0) AS is_refund,
  COALESCE(CAST(TRANSACTION_TYPE = 'Purchase with cashback' AS INTEGER), 0) AS is_purchase_cashback,
  COALESCE(CAST(TRANSACTION_TYPE = 'Cash Advance/Withdrawal' AS INTEGER), 0) AS is_cash_advance,
  COALESCE(CAST(TRANSACTION_CURRENCY = 'RON' AS INTEGER), 0) AS is_ron_currency,
  COALESCE(CAST(CARD_COUNTRY_CODE = 'RO' AS INTEGER), 0) AS is_ro_country,
  COALESCE(CAST(TRANSACTION_CURRENCY = 'RON' AS INTEGER), 0) * COALESCE(CAST(CARD_COUNTRY_CODE = 'RO' AS INTEGER), 0) AS ron_ro_combined,
  COALESCE(CAST(TRANSACTION_CURRENCY IN ('RON', 'AED') AS INTEGER), 0) AS is_high_risk_currency,
  COALESCE(CAST(CARD_COUNTRY_CODE IN ('AE', 'RO', 'FI') AS INTEGER), 0) AS is_high_risk_country,
  COALESCE(CAST(ACQUIRER_ID IN ('ACQ5', 'ACQ6') AS INTEGER), 0) AS is_high_risk_acquirer,
  COALESCE(CAST(MCC_CODE IN ('Brand#1', 'Brand#7', 'Brand#13') AS INTEGER), 0) AS is_high_risk_mcc,
  COALESCE(CAST(OUTLET_TYPE = 'Ecommerce' AS INTEGER), 0) AS is_ecommerce_only,
  COALESCE(CAST(OUTLET_TYPE = 'Face to Face' AS INTEGER), 0) AS is_face_to_face_only,
  COALESCE(CAST(OUTLET_TYPE = 'Face to Face and Ecommerce' AS INTEGER), 0) AS is_mixed_outlet,
  COALESCE(CASE CARD_BRAND WHEN 'AMEX' THEN 3 WHEN 'Discover' THEN 2 WHEN 'MasterCard' THEN 1 WHEN 'Visa' THEN 1 END, 0) AS brand_risk,
  CAST(FAILURE_CODE IS NOT NULL AS INTEGER) AS has_failure,
  CAST(COALESCE(CAST(lower(trim(TAX_EXCEMPT_INDICATOR)) IN ('1', 'true', 't', 'yes', 'y') AS BOOLEAN), false) AS INTEGER) AS tax_exempt,
  COALESCE(CAST(CARDHOLDER_AUTH_METHOD = 'No CVM performed' AS INTEGER), 0) * COALESCE(CAST(TRANSACTION_CASHBACK_AMOUNT > 0 AS INTEGER), 0)
    AS cashback_no_auth
FROM {STAR}""")
def h24_h33_string_flags(spark, sf):
    """H24-H33 PAN parts, splits, contains / equality / membership flags, ordinal maps, H31 interactions."""
    j = joined(spark, sf)
    pan = S.pan_parts("CARD_DATA")
    eq = S.eq_flag
    tax = F.lower(F.trim("TAX_EXCEMPT_INDICATOR")).isin(S.TRUE_WORDS)
    return j.select(
        "TX_ID", *[pan[n].alias(n) for n in ["card_first_digit", "card_bin4", "card_last4", "card_issuer"]],
        S.split_part("CARD_EXPIRY_DATE", "/", 1).alias("expiry_yy"),
        S.contains_flag("CARDHOLDER_AUTH_METHOD", "PIN").alias("pin_auth"),
        S.contains_flag("CARDHOLDER_AUTH_METHOD", "Offline").alias("offline_auth"),
        eq("CARDHOLDER_AUTH_METHOD", "No CVM performed").alias("no_auth"),
        eq("CARDHOLDER_AUTH_METHOD", "Signature").alias("signature_only"),
        eq("CARD_BRAND", "Visa").alias("is_visa"), eq("CARD_BRAND", "AMEX").alias("is_amex"),
        eq("CARD_BRAND", "Discover").alias("is_discover"),
        eq("TRANSACTION_STATUS", "Rejected").alias("is_rejected"), eq("TRANSACTION_STATUS", "Authorized").alias("is_authorized"),
        eq("TRANSACTION_TYPE", "Refund").alias("is_refund"),
        eq("TRANSACTION_TYPE", "Purchase with cashback").alias("is_purchase_cashback"),
        eq("TRANSACTION_TYPE", "Cash Advance/Withdrawal").alias("is_cash_advance"),
        eq("TRANSACTION_CURRENCY", "RON").alias("is_ron_currency"), eq("CARD_COUNTRY_CODE", "RO").alias("is_ro_country"),
        (eq("TRANSACTION_CURRENCY", "RON") * eq("CARD_COUNTRY_CODE", "RO")).alias("ron_ro_combined"),
        S.in_flag("TRANSACTION_CURRENCY", S.HIGH_RISK_CURRENCIES).alias("is_high_risk_currency"),
        S.in_flag("CARD_COUNTRY_CODE", S.HIGH_RISK_COUNTRIES).alias("is_high_risk_country"),
        S.in_flag("ACQUIRER_ID", S.HIGH_RISK_ACQUIRERS).alias("is_high_risk_acquirer"),
        S.in_flag("MCC_CODE", ["Brand#1", "Brand#7", "Brand#13"]).alias("is_high_risk_mcc"),
        eq("OUTLET_TYPE", "Ecommerce").alias("is_ecommerce_only"), eq("OUTLET_TYPE", "Face to Face").alias("is_face_to_face_only"),
        eq("OUTLET_TYPE", "Face to Face and Ecommerce").alias("is_mixed_outlet"),
        S.ordinal_map("CARD_BRAND", {"AMEX": 3, "Discover": 2, "MasterCard": 1, "Visa": 1}).alias("brand_risk"),
        S.not_null_flag("FAILURE_CODE").alias("has_failure"), S.bool_int(tax).alias("tax_exempt"),
        (eq("CARDHOLDER_AUTH_METHOD", "No CVM performed")
         * S.cashback_features("TX_AMOUNT", "TRANSACTION_GOODS_AND_SERVICES_AMOUNT",
                               "TRANSACTION_CASHBACK_AMOUNT")["has_cashback"]).alias("cashback_no_auth"))


@query("h1_parse_timestamps_coerce", """
SELECT TX_ID, epoch_us(TRY_CAST(s AS TIMESTAMP)) AS parsed_us FROM (
  SELECT TX_ID, CASE WHEN TX_ID % 7 = 0 THEN 'not a date' ELSE strftime(TX_TS, '%Y-%m-%d %H:%M:%S') END AS s FROM tx)""")
def h1_parse_timestamps_coerce(spark, sf):
    """H1: string timestamps parsed with coercion (bad strings -> NULL, no error)."""
    t = tx(spark, sf).select("TX_ID", F.when(F.col("TX_ID") % 7 == 0, F.lit("not a date"))
                             .otherwise(F.date_format("TX_TS", "yyyy-MM-dd HH:mm:ss")).alias("s"))
    return t.select("TX_ID", F.unix_micros(S.parse_ts("s")).alias("parsed_us"))
