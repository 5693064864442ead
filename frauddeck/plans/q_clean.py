"""Registered queries: sources, cleaning and joins (SURVEY A*, B*, C*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from frauddeck.functions import scalars as S
from frauddeck.operators import clean, profile, star, windows
from frauddeck.plans.catalog import query
from frauddeck.plans.common import joined, ltx, r, tx, views
from frauddeck.sources import adapter

TX_COLS = ("TX_ID, epoch_us(TX_TS) AS TX_TS_us, CUSTOMER_ID, TERMINAL_ID, MERCHANT_ID, ROUND(TX_AMOUNT, 6) AS TX_AMOUNT, "
           "TX_FRAUD, ROUND(TRANSACTION_GOODS_AND_SERVICES_AMOUNT, 6) AS TRANSACTION_GOODS_AND_SERVICES_AMOUNT, "
           "ROUND(TRANSACTION_CASHBACK_AMOUNT, 6) AS TRANSACTION_CASHBACK_AMOUNT, CARD_EXPIRY_DATE, CARD_DATA, "
           "CARD_BRAND, TRANSACTION_TYPE, TRANSACTION_STATUS, FAILURE_CODE, TRANSACTION_CURRENCY, CARD_COUNTRY_CODE, "
           "IS_RECURRING_TRANSACTION, ACQUIRER_ID, CARDHOLDER_AUTH_METHOD")


@query("a2_payments_view", f"SELECT {TX_COLS} FROM tx")
def a2_payments_view(spark, sf):
    """A2 typed read of the transaction table (adapter over the driver parquet files)."""
    t = tx(spark, sf)
    return t.select("TX_ID", F.unix_micros("TX_TS").alias("TX_TS_us"), *[
        r(c).alias(c) if c in ("TX_AMOUNT", "TRANSACTION_GOODS_AND_SERVICES_AMOUNT", "TRANSACTION_CASHBACK_AMOUNT")
        else F.col(c) for c in t.columns if c not in ("TX_ID", "TX_TS")])


@query("a2_lineitem_payments_view", f"SELECT {TX_COLS} FROM ltx")
def a2_lineitem_payments_view(spark, sf):
    t = ltx(spark, sf)
    return t.select("TX_ID", F.unix_micros("TX_TS").alias("TX_TS_us"), *[
        r(c).alias(c) if c in ("TX_AMOUNT", "TRANSACTION_GOODS_AND_SERVICES_AMOUNT", "TRANSACTION_CASHBACK_AMOUNT")
        else F.col(c) for c in t.columns if c not in ("TX_ID", "TX_TS")])


@query("b1_first_tx_per_customer", """
SELECT CUSTOMER_ID, TX_ID, ROUND(TX_AMOUNT, 6) AS TX_AMOUNT FROM (
  SELECT *, row_number() OVER (PARTITION BY CUSTOMER_ID ORDER BY TX_TS, TX_ID) AS rn FROM tx) WHERE rn = 1""")
def b1_first_tx_per_customer(spark, sf):
    d = clean.dedup_keep_first(tx(spark, sf), ["CUSTOMER_ID"], ["TX_TS", "TX_ID"])
    return d.select("CUSTOMER_ID", "TX_ID", r("TX_AMOUNT").alias("TX_AMOUNT"))


@query("b2_latest_per_order", """
SELECT ORDER_KEY, TX_ID, epoch_us(TX_TS) AS TX_TS_us FROM (
  SELECT *, row_number() OVER (PARTITION BY ORDER_KEY ORDER BY TX_TS DESC, TX_ID) AS rn
  FROM (SELECT *, CAST(split_part(TX_ID, '-', 1) AS BIGINT) AS ORDER_KEY FROM ltx)) WHERE rn = 1""")
def b2_latest_per_order(spark, sf):
    d = ltx(spark, sf).withColumn("ORDER_KEY", S.split_part("TX_ID", "-", 0).cast("bigint"))
    d = clean.dedup_keep_latest(d, "ORDER_KEY", "TX_TS", ["TX_ID"])
    return d.select("ORDER_KEY", "TX_ID", F.unix_micros("TX_TS").alias("TX_TS_us"))


@query("b3_drop_null_required", """
SELECT TX_ID, TERMINAL_ID FROM tx LEFT JOIN terminals USING (TERMINAL_ID)
WHERE x_terminal_id IS NOT NULL AND FAILURE_CODE IS NOT NULL""")
def b3_drop_null_required(spark, sf):
    v = views(spark, sf)
    j = star.star_join(v["transactions"], terminals=v["terminals"])
    return clean.drop_null_required(j, ["x_terminal_id", "FAILURE_CODE"]).select("TX_ID", "TERMINAL_ID")


CLEAN_M_SQL = """
SELECT MERCHANT_ID, BUSINESS_TYPE, MCC_CODE, OUTLET_TYPE,
  CAST(CASE WHEN t IS NULL THEN false WHEN t IN ('1','true','t','yes','y') THEN true
       WHEN t IN ('0','false','f','no','n') THEN false WHEN starts_with(t, 't') OR starts_with(t, 'y') THEN true
       ELSE false END AS INTEGER) AS TAX_EXCEMPT_INDICATOR,
  ROUND(GREATEST(COALESCE(ANNUAL_TURNOVER_CARD, 0), 0), 6) AS ANNUAL_TURNOVER_CARD,
  ROUND(GREATEST(COALESCE(ANNUAL_TURNOVER, 0), 0), 6) AS ANNUAL_TURNOVER,
  ROUND(GREATEST(COALESCE(AVERAGE_TICKET_SALE_AMOUNT, 0), 0), 6) AS AVERAGE_TICKET_SALE_AMOUNT,
  LEAST(GREATEST(PAYMENT_PERCENTAGE_FACE_TO_FACE, 0), 100) AS PAYMENT_PERCENTAGE_FACE_TO_FACE,
  LEAST(GREATEST(PAYMENT_PERCENTAGE_ECOM, 0), 100) AS PAYMENT_PERCENTAGE_ECOM,
  LEAST(GREATEST(PAYMENT_PERCENTAGE_MOTO, 0), 100) AS PAYMENT_PERCENTAGE_MOTO,
  LEAST(GREATEST(DEPOSIT_REQUIRED_PERCENTAGE, 0), 100) AS DEPOSIT_REQUIRED_PERCENTAGE,
  LEAST(GREATEST(DEPOSIT_PERCENTAGE, 0), 100) AS DEPOSIT_PERCENTAGE,
  LEAST(GREATEST(DELIVERY_SAME_DAYS_PERCENTAGE, 0), 100) AS DELIVERY_SAME_DAYS_PERCENTAGE,
  LEAST(GREATEST(DELIVERY_OVER_TWO_WEEKS_PERCENTAGE, 0), 100) AS DELIVERY_OVER_TWO_WEEKS_PERCENTAGE
FROM (SELECT *, lower(trim(TAX_EXCEMPT_INDICATOR)) AS t FROM merchants)"""


@query("p1_clean_merchants", CLEAN_M_SQL)
def p1_clean_merchants(spark, sf):
    """P1 merchants: B1 dedup, B4 percent clip, B5 money floor, B6 fuzzy boolean, B10 drop."""
    m = clean.clean_merchants(adapter.merchants(spark, sf))
    money = ["ANNUAL_TURNOVER_CARD", "ANNUAL_TURNOVER", "AVERAGE_TICKET_SALE_AMOUNT"]
    return m.select(*[F.col(c).cast("int").alias(c) if c == "TAX_EXCEMPT_INDICATOR"
                      else (r(c).alias(c) if c in money else F.col(c)) for c in m.columns])


@query("p1_clean_customers", """
SELECT CUSTOMER_ID, LEAST(GREATEST(x_customer_id, 0), 100) AS x_customer_id,
       LEAST(GREATEST(y_customer_id, 0), 100) AS y_customer_id, SEGMENT
FROM customers WHERE x_customer_id IS NOT NULL AND y_customer_id IS NOT NULL""")
def p1_clean_customers(spark, sf):
    """P1 customers: B1 dedup, B3 required columns, B4 coordinate clip."""
    return clean.clean_customers(adapter.customers(spark, sf))


@query("p1_clean_terminals", """
SELECT TERMINAL_ID, LEAST(GREATEST(x_terminal_id, 0), 100) AS x_terminal_id,
       LEAST(GREATEST(y_terminal_id, 0), 100) AS y_terminal_id
FROM terminals WHERE x_terminal_id IS NOT NULL AND y_terminal_id IS NOT NULL""")
def p1_clean_terminals(spark, sf):
    return clean.clean_terminals(adapter.terminals(spark, sf))


CLEAN_TX_SQL = """
SELECT TX_ID, epoch_us(TX_TS) AS TX_TS_us, CUSTOMER_ID, TERMINAL_ID, MERCHANT_ID,
  ROUND(amt, 6) AS TX_AMOUNT,
  ROUND(CASE WHEN g + cb > amt THEN GREATEST(g * amt / (CASE WHEN g + cb = 0 THEN 1 ELSE g + cb END), 0) ELSE g END, 6)
    AS TRANSACTION_GOODS_AND_SERVICES_AMOUNT,
  ROUND(CASE WHEN g + cb > amt THEN GREATEST(cb * amt / (CASE WHEN g + cb = 0 THEN 1 ELSE g + cb END), 0) ELSE cb END, 6)
    AS TRANSACTION_CASHBACK_AMOUNT,
  CARD_DATA, CARD_BRAND, TRANSACTION_TYPE, TRANSACTION_CURRENCY, CARD_COUNTRY_CODE, ACQUIRER_ID,
  CARDHOLDER_AUTH_METHOD,
  CAST(CASE WHEN rec IS NULL THEN false WHEN rec IN ('1','true','t','yes','y') THEN true
       WHEN rec IN ('0','false','f','no','n') THEN false WHEN starts_with(rec, 't') OR starts_with(rec, 'y') THEN true
       ELSE false END AS INTEGER) AS IS_RECURRING_TRANSACTION,
  CASE WHEN ok THEN CAST(mm AS DOUBLE) END AS card_expiry_month_clean,
  CASE WHEN ok THEN CAST(yy + 2000 AS DOUBLE) END AS card_expiry_year_clean,
  LEAST(GREATEST(COALESCE(TX_FRAUD, 0), 0), 1) AS TX_FRAUD
FROM (
  SELECT *, GREATEST(COALESCE(TX_AMOUNT, 0), 0) AS amt,
    GREATEST(COALESCE(TRANSACTION_GOODS_AND_SERVICES_AMOUNT, 0), 0) AS g,
    GREATEST(COALESCE(TRANSACTION_CASHBACK_AMOUNT, 0), 0) AS cb,
    lower(trim(IS_RECURRING_TRANSACTION)) AS rec,
    TRY_CAST(trim(split_part(CARD_EXPIRY_DATE, '/', 1)) AS INTEGER) AS mm,
    TRY_CAST(trim(split_part(CARD_EXPIRY_DATE, '/', 2)) AS INTEGER) AS yy,
    (CARD_EXPIRY_DATE LIKE '%/%' AND len(string_split(CARD_EXPIRY_DATE, '/')) = 2
      AND TRY_CAST(trim(split_part(CARD_EXPIRY_DATE, '/', 1)) AS INTEGER) BETWEEN 1 AND 12
      AND TRY_CAST(trim(split_part(CARD_EXPIRY_DATE, '/', 2)) AS INTEGER) IS NOT NULL) AS ok
  FROM (SELECT *, row_number() OVER (PARTITION BY TX_ID ORDER BY TX_TS DESC, CUSTOMER_ID, TERMINAL_ID, TX_AMOUNT) AS rn
        FROM tx) WHERE rn = 1
    AND TX_ID IS NOT NULL AND CUSTOMER_ID IS NOT NULL AND TERMINAL_ID IS NOT NULL AND TX_TS IS NOT NULL)"""


@query("p1_clean_transactions", CLEAN_TX_SQL)
def p1_clean_transactions(spark, sf):
    """P1 transactions: B2 latest per id, B3, B5, B6, B7 expiry, B8 rescale, B9 label, B10 drop."""
    d = clean.clean_transactions(tx(spark, sf))
    money = ["TX_AMOUNT", "TRANSACTION_GOODS_AND_SERVICES_AMOUNT", "TRANSACTION_CASHBACK_AMOUNT"]
    cols = []
    for c in d.columns:
        if c == "TX_TS":
            cols.append(F.unix_micros("TX_TS").alias("TX_TS_us"))
        elif c in money:
            cols.append(r(c).alias(c))
        elif c == "IS_RECURRING_TRANSACTION":
            cols.append(F.col(c).cast("int").alias(c))
        else:
            cols.append(F.col(c))
    return d.select(*cols)


FEATS = ["TX_AMOUNT", "x_customer_id", "ANNUAL_TURNOVER_CARD_LOG1P", "not_a_column", "p_size_missing"]


@query("b12_project_features", """
SELECT TX_ID, TX_FRAUD, CAST(TX_AMOUNT AS DOUBLE) AS TX_AMOUNT, CAST(x_customer_id AS DOUBLE) AS x_customer_id,
  ROUND(CAST(annual_turnover_card_log1p AS DOUBLE), 6) AS ANNUAL_TURNOVER_CARD_LOG1P, CAST(0 AS DOUBLE) AS not_a_column, CAST(0 AS DOUBLE) AS p_size_missing
FROM (SELECT t.*, c.x_customer_id, ln(1 + GREATEST(COALESCE(m.ANNUAL_TURNOVER_CARD, 0), 0)) AS annual_turnover_card_log1p
      FROM tx t LEFT JOIN merchants m USING (MERCHANT_ID) LEFT JOIN customers c USING (CUSTOMER_ID))""")
def b12_project_features(spark, sf):
    """B12 projection to a feature list (B13 optional columns, quirk Q1)."""
    j = joined(spark, sf).withColumn("annual_turnover_card_log1p", S.log1p0("ANNUAL_TURNOVER_CARD"))
    p = clean.project_features(j, FEATS, keep=["TX_ID", "TX_FRAUD"])
    return p.withColumn("ANNUAL_TURNOVER_CARD_LOG1P", r("ANNUAL_TURNOVER_CARD_LOG1P"))


@query("b14_fill_zero", """
SELECT TX_ID, COALESCE(FAILURE_CODE, '0') AS FAILURE_CODE, COALESCE(x_terminal_id, 0) AS x_terminal_id
FROM tx LEFT JOIN terminals USING (TERMINAL_ID)""")
def b14_fill_zero(spark, sf):
    v = views(spark, sf)
    j = star.star_join(v["transactions"], terminals=v["terminals"]).select("TX_ID", "FAILURE_CODE", "x_terminal_id")
    return clean.fill_zero_all(j)


@query("b15_impute_median", """
WITH d AS (SELECT TX_ID, CASE WHEN TX_FRAUD = 1 THEN NULL ELSE TX_AMOUNT END AS legit_amount FROM tx)
SELECT TX_ID, ROUND(COALESCE(legit_amount, (SELECT quantile_cont(legit_amount, 0.5) FROM d)), 6) AS legit_amount FROM d""")
def b15_impute_median(spark, sf):
    d = tx(spark, sf).select("TX_ID", F.when(F.col("TX_FRAUD") == 1, None).otherwise(F.col("TX_AMOUNT"))
                             .alias("legit_amount"))
    return clean.impute_median(d, ["legit_amount"]).select("TX_ID", r("legit_amount").alias("legit_amount"))


@query("b16_null_tokens", """
SELECT TX_ID, COALESCE(CAST(FAILURE_CODE AS VARCHAR), 'MISSING') AS FAILURE_CODE,
  COALESCE(CAST(CARD_BRAND AS VARCHAR), 'MISSING') AS CARD_BRAND,
  COALESCE(CAST(TERMINAL_ID AS VARCHAR), 'MISSING') AS TERMINAL_ID FROM tx""")
def b16_null_tokens(spark, sf):
    d = tx(spark, sf).select("TX_ID", "FAILURE_CODE", "CARD_BRAND", "TERMINAL_ID")
    return clean.null_tokens(d, ["FAILURE_CODE", "CARD_BRAND", "TERMINAL_ID", "ABSENT_COL"])


@query("b17_coerce_numbers", """
SELECT TX_ID, COALESCE(TRY_CAST(split_part(CARD_EXPIRY_DATE, '/', 1) AS DOUBLE), 0.0) AS exp_month,
  COALESCE(TRY_CAST(CARD_DATA AS DOUBLE), 0.0) AS card_num FROM tx""")
def b17_coerce_numbers(spark, sf):
    t = tx(spark, sf)
    return t.select("TX_ID", S.to_number_or_zero(S.split_part("CARD_EXPIRY_DATE", "/", 0)).alias("exp_month"),
                    S.to_number_or_zero("CARD_DATA").alias("card_num"))


@query("b18_filter_rows", """
SELECT TX_ID, TRANSACTION_TYPE FROM tx WHERE TX_FRAUD = 1 AND TRANSACTION_TYPE <> 'Refund' AND TX_AMOUNT > 100""")
def b18_filter_rows(spark, sf):
    t = tx(spark, sf)
    return t.filter((F.col("TX_FRAUD") == 1) & (F.col("TRANSACTION_TYPE") != "Refund") & (F.col("TX_AMOUNT") > 100)) \
            .select("TX_ID", "TRANSACTION_TYPE")


@query("b19_clip_binarise", """
SELECT TX_ID, ROUND(LEAST(GREATEST(TX_FRAUD * 1.5 - 0.2, 0), 1), 6) AS score,
  CAST(LEAST(GREATEST(TX_FRAUD * 1.5 - 0.2, 0), 1) >= 0.5 AS INTEGER) AS pred,
  CAST(LEAST(GREATEST(TX_FRAUD * 1.5 - 0.2, 0), 1) > 0.5 AS INTEGER) AS pred_strict FROM scores_a""")
def b19_clip_binarise(spark, sf):
    s = adapter.scores_a(tx(spark, sf)).select("TX_ID", (F.col("TX_FRAUD") * 1.5 - 0.2).alias("raw"))
    sc = S.clip_score("raw")
    return s.select("TX_ID", r(sc).alias("score"), S.binarise(sc).alias("pred"),
                    S.binarise(sc, strict=True).alias("pred_strict"))


@query("c1_star_join", """
SELECT TX_ID, MCC_CODE, BUSINESS_TYPE, x_customer_id, y_customer_id, x_terminal_id, y_terminal_id
FROM tx LEFT JOIN merchants USING (MERCHANT_ID) LEFT JOIN customers USING (CUSTOMER_ID)
LEFT JOIN terminals USING (TERMINAL_ID)""")
def c1_star_join(spark, sf):
    return joined(spark, sf).select("TX_ID", "MCC_CODE", "BUSINESS_TYPE", "x_customer_id", "y_customer_id",
                                    "x_terminal_id", "y_terminal_id")


@query("c2_inner_star_distance", """
SELECT TX_ID, ROUND(sqrt(pow(x_customer_id - x_terminal_id, 2) + pow(y_customer_id - y_terminal_id, 2)), 6) AS distance
FROM tx JOIN customers USING (CUSTOMER_ID) JOIN terminals USING (TERMINAL_ID)""")
def c2_inner_star_distance(spark, sf):
    v = views(spark, sf)
    j = star.star_join(v["transactions"], v["customers"], v["terminals"], how="inner")
    return j.select("TX_ID", r(S.distance("x_customer_id", "y_customer_id", "x_terminal_id", "y_terminal_id"))
                    .alias("distance"))


@query("c3_dim_fact_counts", """
SELECT c.CUSTOMER_ID, COALESCE(n_tx, 0) + 1 AS n_tx, COALESCE(n_fraud, 0) + 1 AS n_fraud
FROM customers c LEFT JOIN (SELECT CUSTOMER_ID, COUNT(*) AS n_tx, CAST(SUM(TX_FRAUD) AS BIGINT) AS n_fraud
  FROM tx GROUP BY CUSTOMER_ID) a USING (CUSTOMER_ID)""")
def c3_dim_fact_counts(spark, sf):
    v = views(spark, sf)
    return star.dim_with_fact_counts(v["customers"].select("CUSTOMER_ID"), v["transactions"], "CUSTOMER_ID",
                                     plus_one=True)


@query("c4_align_scores", """
SELECT a.TX_ID, ROUND(a.TX_FRAUD, 6) AS TX_FRAUD_a, ROUND(b.TX_FRAUD, 6) AS TX_FRAUD_b
FROM scores_a a JOIN scores_b b USING (TX_ID)""")
def c4_align_scores(spark, sf):
    t = tx(spark, sf)
    j = star.align_scores(adapter.scores_a(t), adapter.scores_b(t))
    return j.select("TX_ID", r("TX_FRAUD_a").alias("TX_FRAUD_a"), r("TX_FRAUD_b").alias("TX_FRAUD_b"))


@query("c5_labels_and_scores", """
SELECT t.TX_ID, t.TX_FRAUD AS y, ROUND(a.TX_FRAUD, 6) AS p_a, ROUND(b.TX_FRAUD, 6) AS p_b
FROM tx t JOIN scores_a a USING (TX_ID) JOIN scores_b b USING (TX_ID)""")
def c5_labels_and_scores(spark, sf):
    t = tx(spark, sf)
    j = star.labels_and_scores(t, adapter.scores_a(t), adapter.scores_b(t))
    return j.select("TX_ID", "y", r("p_a").alias("p_a"), r("p_b").alias("p_b"))


@query("c6_e19_customer_deviation", """
SELECT TX_ID, ROUND(m, 6) AS cust_mean, ROUND(s, 4) AS cust_std, n AS cust_n,
  ROUND(abs(TX_AMOUNT - m) / s, 4) AS amount_dev_std
FROM tx JOIN (SELECT CUSTOMER_ID, avg(TX_AMOUNT) AS m, stddev_samp(TX_AMOUNT) AS s, count(TX_AMOUNT) AS n
  FROM tx GROUP BY CUSTOMER_ID) USING (CUSTOMER_ID)""")
def c6_e19_customer_deviation(spark, sf):
    d = windows.add_entity_stats(tx(spark, sf), "CUSTOMER_ID", "TX_AMOUNT",
                                 {"cust_mean": "mean", "cust_std": "std", "cust_n": "count"})
    return d.select("TX_ID", r("cust_mean").alias("cust_mean"), r("cust_std", 4).alias("cust_std"), "cust_n",
                    r(F.abs(F.col("TX_AMOUNT") - F.col("cust_mean")) / F.col("cust_std"), 4).alias("amount_dev_std"))


@query("c7_train_stats_on_test", """
WITH tr AS (SELECT * FROM tx WHERE TX_TS < TIMESTAMP '2024-01-20'),
     te AS (SELECT * FROM tx WHERE TX_TS >= TIMESTAMP '2024-01-20'),
     st AS (SELECT TERMINAL_ID, avg(TX_FRAUD) AS term_rate, count(*) AS term_n FROM tr GROUP BY TERMINAL_ID)
SELECT TX_ID, ROUND(COALESCE(term_rate, -1.0), 6) AS term_rate, COALESCE(term_n, 0) AS term_n
FROM te LEFT JOIN st USING (TERMINAL_ID)""")
def c7_train_stats_on_test(spark, sf):
    t = tx(spark, sf)
    cut = F.lit("2024-01-20 00:00:00").cast("timestamp")
    tr, te = t.filter(F.col("TX_TS") < cut), t.filter(F.col("TX_TS") >= cut)
    out = star.lookup_from_reference(te, tr, "TERMINAL_ID",
                                     {"term_rate": F.avg("TX_FRAUD"), "term_n": F.count(F.lit(1))},
                                     {"term_rate": -1.0, "term_n": 0})
    return out.select("TX_ID", r("term_rate").alias("term_rate"), "term_n")


COMPROMISED_SQL = """(SELECT MERCHANT_ID FROM ltx GROUP BY MERCHANT_ID HAVING count(*) >= 5 AND avg(TX_FRAUD) >= 0.5)"""


@query("c8_membership_flag", f"""
SELECT TX_ID, CASE WHEN c.MERCHANT_ID IS NULL THEN 0 ELSE 1 END AS is_compromised
FROM ltx LEFT JOIN {COMPROMISED_SQL} c USING (MERCHANT_ID)""")
def c8_membership_flag(spark, sf):
    t = ltx(spark, sf)
    bad = profile.compromised_entities(t, "MERCHANT_ID", min_count=5, threshold=0.5)
    return star.membership_flag(t, bad, "MERCHANT_ID", "is_compromised").select("TX_ID", "is_compromised")


@query("c9_anti_filter", f"""
SELECT TX_ID FROM ltx WHERE MERCHANT_ID NOT IN {COMPROMISED_SQL}""")
def c9_anti_filter(spark, sf):
    t = ltx(spark, sf)
    bad = profile.compromised_entities(t, "MERCHANT_ID", min_count=5, threshold=0.5)
    return star.anti_filter(t, bad, "MERCHANT_ID").select("TX_ID")


@query("b10_b11_drop_and_rename", """
SELECT TX_ID, CARD_DATA AS masked_pan, TX_AMOUNT AS amount FROM tx""")
def b10_b11_drop_and_rename(spark, sf):
    """B10 drop leakage / low-value columns, B11 rename."""
    t = tx(spark, sf).select("TX_ID", "CARD_DATA", "TX_AMOUNT", "FAILURE_CODE", "TRANSACTION_STATUS")
    d = clean.drop_columns(t, ["FAILURE_CODE", "TRANSACTION_STATUS", "NOT_PRESENT"])
    return clean.rename(d, {"CARD_DATA": "masked_pan", "TX_AMOUNT": "amount", "y_terminal__id": "y_terminal_id"})
