"""Registered queries: profiling reports (SURVEY D*, F*, G*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from frauddeck.functions import scalars as S
from frauddeck.operators import profile as P
from frauddeck.plans.catalog import query
from frauddeck.plans.common import joined, ltx, r, tx, views
from frauddeck.sources import adapter


def _rate_cols(df, key):
    return df.select(key, "n_tx", "n_fraud", r("fraud_rate").alias("fraud_rate"))


RATE = "COUNT(*) AS n_tx, CAST(SUM(TX_FRAUD) AS BIGINT) AS n_fraud, ROUND(AVG(TX_FRAUD), 6) AS fraud_rate"
STAR = ("tx LEFT JOIN merchants USING (MERCHANT_ID) LEFT JOIN customers USING (CUSTOMER_ID) "
        "LEFT JOIN terminals USING (TERMINAL_ID)")


@query("d1_overall_rate", f"SELECT {RATE} FROM ltx")
def d1_overall_rate(spark, sf):
    return _rate_cols(P.overall_rate(ltx(spark, sf)).withColumn("_k", F.lit(1)), "_k").drop("_k")


@query("d2_rows_by_hour", "SELECT CAST(hour(TX_TS) AS BIGINT) AS hour, COUNT(*) AS n_tx FROM tx GROUP BY 1")
def d2_rows_by_hour(spark, sf):
    return tx(spark, sf).groupBy(F.hour("TX_TS").cast("bigint").alias("hour")).agg(F.count(F.lit(1)).alias("n_tx"))


def _dim_query(name, col, expr_sql=None, src="tx", fact="events", star=False, min_count=0):
    key_sql = expr_sql or col
    frm = STAR if star else src
    having = f" HAVING COUNT(*) >= {min_count}" if min_count else ""
    sql = f"SELECT {key_sql} AS {col}, {RATE} FROM {frm} WHERE {key_sql} IS NOT NULL GROUP BY 1{having}"

    @query(name, sql)
    def _q(spark, sf):
        d = joined(spark, sf, fact) if star else (tx(spark, sf) if src == "tx" else ltx(spark, sf))
        return _rate_cols(P.rate_by(d, col, min_count=min_count), col)
    return _q


for _dim in ["CARD_BRAND", "TRANSACTION_TYPE", "TRANSACTION_CURRENCY", "CARDHOLDER_AUTH_METHOD", "ACQUIRER_ID",
             "TRANSACTION_STATUS", "IS_RECURRING_TRANSACTION"]:
    _dim_query(f"d3_rate_by_{_dim.lower()}", _dim)
for _dim in ["BUSINESS_TYPE", "OUTLET_TYPE"]:
    _dim_query(f"d3_rate_by_{_dim.lower()}", _dim, star=True)


@query("d3_rate_by_hour", f"SELECT CAST(hour(TX_TS) AS BIGINT) AS hour, {RATE} FROM tx GROUP BY 1")
def d3_rate_by_hour(spark, sf):
    return _rate_cols(P.rate_by(tx(spark, sf), {"hour": F.hour("TX_TS").cast("bigint")}), "hour")


@query("d3_rate_by_month", f"SELECT CAST(month(TX_TS) AS BIGINT) AS month, {RATE} FROM ltx GROUP BY 1")
def d3_rate_by_month(spark, sf):
    return _rate_cols(P.rate_by(ltx(spark, sf), {"month": F.month("TX_TS").cast("bigint")}), "month")


@query("d4_rate_by_mcc_min_support", f"""
SELECT MCC_CODE, {RATE} FROM tx LEFT JOIN merchants USING (MERCHANT_ID)
WHERE MCC_CODE IS NOT NULL GROUP BY MCC_CODE HAVING COUNT(*) >= 100""")
def d4_rate_by_mcc_min_support(spark, sf):
    """Flagship: star join + fraud rate per merchant category, minimum support 100."""
    v = views(spark, sf)
    from frauddeck.operators.star import star_join
    j = star_join(v["transactions"], merchants=v["merchants"])
    return _rate_cols(P.rate_by(j, "MCC_CODE", min_count=100), "MCC_CODE")


@query("d4_rate_by_terminal_min_support", f"""
SELECT TERMINAL_ID, {RATE} FROM ltx GROUP BY TERMINAL_ID HAVING COUNT(*) >= 50""")
def d4_rate_by_terminal_min_support(spark, sf):
    return _rate_cols(P.rate_by(ltx(spark, sf), "TERMINAL_ID", min_count=50), "TERMINAL_ID")


@query("d4_rate_by_country_min_support", f"""
SELECT CARD_COUNTRY_CODE, {RATE} FROM ltx GROUP BY 1 HAVING COUNT(*) >= 1000""")
def d4_rate_by_country_min_support(spark, sf):
    return _rate_cols(P.rate_by(ltx(spark, sf), "CARD_COUNTRY_CODE", min_count=1000), "CARD_COUNTRY_CODE")


@query("d4_d5_top20_mcc_by_rate", f"""
SELECT MCC_CODE, {RATE} FROM ltx LEFT JOIN merchants USING (MERCHANT_ID)
WHERE MCC_CODE IS NOT NULL GROUP BY MCC_CODE HAVING COUNT(*) >= 100 ORDER BY AVG(TX_FRAUD) DESC, MCC_CODE LIMIT 20""")
def d4_d5_top20_mcc_by_rate(spark, sf):
    j = joined(spark, sf, "lineitem")
    return _rate_cols(P.rate_by(j, "MCC_CODE", min_count=100, top=20), "MCC_CODE")


@query("d5_top20_terminals_by_rate", f"""
SELECT TERMINAL_ID, {RATE} FROM ltx GROUP BY TERMINAL_ID HAVING COUNT(*) >= 50
ORDER BY AVG(TX_FRAUD) DESC, TERMINAL_ID LIMIT 20""")
def d5_top20_terminals_by_rate(spark, sf):
    return _rate_cols(P.rate_by(ltx(spark, sf), "TERMINAL_ID", min_count=50, top=20), "TERMINAL_ID")


@query("d6_positive_terminal_share", """
SELECT TERMINAL_ID, COUNT(*) AS n_fraud, ROUND(COUNT(*) / (SELECT COUNT(*) FROM ltx WHERE TX_FRAUD = 1), 6) AS fraud_share
FROM ltx WHERE TX_FRAUD = 1 GROUP BY TERMINAL_ID""")
def d6_positive_terminal_share(spark, sf):
    d = P.positives_share(ltx(spark, sf), "TERMINAL_ID")
    return d.select("TERMINAL_ID", "n_fraud", r("fraud_share").alias("fraud_share"))


@query("d7_repeat_positive_customers", """
SELECT CUSTOMER_ID, CAST(SUM(TX_FRAUD) AS BIGINT) AS n_fraud, COUNT(*) AS n_tx FROM tx GROUP BY 1 HAVING SUM(TX_FRAUD) >= 2""")
def d7_repeat_positive_customers(spark, sf):
    return P.repeat_positive_entities(tx(spark, sf), "CUSTOMER_ID")


@query("d8_amount_buckets", """
WITH b AS (SELECT CAST(ceil(TX_AMOUNT / 10) - 1 AS BIGINT) AS bucket, TX_FRAUD FROM tx WHERE TX_AMOUNT > 0 AND TX_AMOUNT <= 800)
SELECT '$' || CAST(bucket * 10 AS VARCHAR) || '-' || CAST(bucket * 10 + 9 AS VARCHAR) AS amount_bucket, bucket,
  COUNT(*) AS n_tx, CAST(SUM(TX_FRAUD) AS BIGINT) AS n_fraud,
  ROUND(SUM(TX_FRAUD) / (SELECT SUM(TX_FRAUD) FROM b) * 100, 6) AS fraud_contribution
FROM b GROUP BY bucket""")
def d8_amount_buckets(spark, sf):
    d = P.amount_buckets(tx(spark, sf))
    return d.select("amount_bucket", "bucket", "n_tx", "n_fraud", r("fraud_contribution").alias("fraud_contribution"))


def _band_sql(col, edges, labels, name, src):
    parts = []
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = f"{col} > {lo}" + ("" if hi == float("inf") else f" AND {col} <= {hi}")
        parts.append(f"WHEN {cond} THEN '{lab}'")
    key = "CASE " + " ".join(parts) + " END"
    return f"SELECT {key} AS {name}, {RATE} FROM {src} WHERE {key} IS NOT NULL GROUP BY 1"


@query("d9_rate_by_amount_band", _band_sql("TX_AMOUNT", P.AMOUNT_EDGES, P.AMOUNT_LABELS, "amount_bin", "tx"))
def d9_rate_by_amount_band(spark, sf):
    d = P.rate_by_bins(tx(spark, sf), "TX_AMOUNT", P.AMOUNT_EDGES, P.AMOUNT_LABELS, "amount_bin")
    return _rate_cols(d, "amount_bin")


DIST_SQL = "sqrt(pow(x_customer_id - x_terminal_id, 2) + pow(y_customer_id - y_terminal_id, 2))"


@query("d10_rate_by_distance_band", _band_sql(DIST_SQL, P.DISTANCE_EDGES, P.DISTANCE_LABELS, "distance_bin", STAR))
def d10_rate_by_distance_band(spark, sf):
    j = joined(spark, sf).withColumn("distance", S.distance("x_customer_id", "y_customer_id",
                                                            "x_terminal_id", "y_terminal_id"))
    d = P.rate_by_bins(j, "distance", P.DISTANCE_EDGES, P.DISTANCE_LABELS, "distance_bin")
    return _rate_cols(d, "distance_bin")


@query("d11_rate_by_weekday", f"SELECT CAST(isodow(TX_TS) - 1 AS BIGINT) AS weekday, {RATE} FROM ltx GROUP BY 1")
def d11_rate_by_weekday(spark, sf):
    return _rate_cols(P.rate_by(ltx(spark, sf), {"weekday": S.weekday("TX_TS").cast("bigint")}), "weekday")


@query("d12_amount_histogram_by_class", """
WITH rng AS (SELECT min(TX_AMOUNT) AS lo, max(TX_AMOUNT) AS hi FROM tx),
b AS (SELECT TX_FRAUD, CAST(LEAST(floor((TX_AMOUNT - lo) / ((hi - lo) / 50)), 49) AS BIGINT) AS bin, lo, hi FROM tx, rng),
tot AS (SELECT TX_FRAUD, COUNT(*) AS n_all FROM tx GROUP BY 1)
SELECT TX_FRAUD, bin, ROUND(lo + bin * (hi - lo) / 50, 6) AS bin_left, ROUND(lo + (bin + 1) * (hi - lo) / 50, 6) AS bin_right,
  COUNT(*) AS n, ROUND(COUNT(*) / (n_all * (hi - lo) / 50), 8) AS density
FROM b JOIN tot USING (TX_FRAUD) GROUP BY TX_FRAUD, bin, lo, hi, n_all""")
def d12_amount_histogram_by_class(spark, sf):
    h = P.histogram(tx(spark, sf), "TX_AMOUNT", 50, by="TX_FRAUD")
    return h.select("TX_FRAUD", "bin", r("bin_left").alias("bin_left"), r("bin_right").alias("bin_right"), "n",
                    r("density", 8).alias("density"))


@query("d13_dataset_summary", """
SELECT COUNT(*) AS n_tx, CAST(SUM(TX_FRAUD) AS BIGINT) AS n_fraud, ROUND(AVG(TX_FRAUD), 6) AS fraud_rate,
  ROUND(AVG(TX_AMOUNT), 6) AS mean_amount, ROUND(quantile_cont(TX_AMOUNT, 0.5), 6) AS median_amount,
  ROUND(AVG(CASE WHEN TX_FRAUD = 1 THEN TX_AMOUNT END), 6) AS mean_fraud_amount,
  ROUND(AVG(CASE WHEN TX_FRAUD = 0 THEN TX_AMOUNT END), 6) AS mean_legit_amount,
  COUNT(DISTINCT CUSTOMER_ID) AS n_customers, COUNT(DISTINCT TERMINAL_ID) AS n_terminals,
  COUNT(DISTINCT MERCHANT_ID) AS n_merchants, epoch_us(MIN(TX_TS)) AS first_ts_us, epoch_us(MAX(TX_TS)) AS last_ts_us
FROM ltx""")
def d13_dataset_summary(spark, sf):
    d = P.dataset_summary(ltx(spark, sf))
    return d.select("n_tx", "n_fraud", *[r(c).alias(c) for c in ["fraud_rate", "mean_amount", "median_amount",
                                                                 "mean_fraud_amount", "mean_legit_amount"]],
                    "n_customers", "n_terminals", "n_merchants",
                    F.unix_micros("first_ts").alias("first_ts_us"), F.unix_micros("last_ts").alias("last_ts_us"))


@query("d14_customer_amount_profile", """
SELECT CUSTOMER_ID, COUNT(TX_AMOUNT) AS customer_amt_count, ROUND(AVG(TX_AMOUNT), 6) AS customer_amt_mean,
  ROUND(stddev_samp(TX_AMOUNT), 4) AS customer_amt_std, MIN(TX_AMOUNT) AS customer_amt_min,
  MAX(TX_AMOUNT) AS customer_amt_max, ROUND(quantile_cont(TX_AMOUNT, 0.5), 6) AS customer_amt_median
FROM ltx GROUP BY CUSTOMER_ID""")
def d14_customer_amount_profile(spark, sf):
    d = P.entity_amount_profile(ltx(spark, sf), "CUSTOMER_ID")
    return d.select("CUSTOMER_ID", "customer_amt_count", r("customer_amt_mean").alias("customer_amt_mean"),
                    r("customer_amt_std", 4).alias("customer_amt_std"), "customer_amt_min", "customer_amt_max",
                    r("customer_amt_median").alias("customer_amt_median"))


@query("d15_terminal_fraud_profile", """
SELECT TERMINAL_ID, ROUND(AVG(COALESCE(TX_FRAUD, 0)), 6) AS terminal_fraud_rate,
  CAST(SUM(COALESCE(TX_FRAUD, 0)) AS BIGINT) AS terminal_fraud_count FROM ltx GROUP BY TERMINAL_ID""")
def d15_terminal_fraud_profile(spark, sf):
    d = P.entity_fraud_profile(ltx(spark, sf), "TERMINAL_ID")
    return d.select("TERMINAL_ID", r("terminal_fraud_rate").alias("terminal_fraud_rate"), "terminal_fraud_count")


D16_COLS = ["CARD_BRAND", "TRANSACTION_TYPE", "TRANSACTION_STATUS", "TRANSACTION_CURRENCY", "CARD_COUNTRY_CODE",
            "ACQUIRER_ID", "CARDHOLDER_AUTH_METHOD", "BUSINESS_TYPE", "MCC_CODE", "OUTLET_TYPE", "SEGMENT"]


def _d16_sql():
    tx_cols = [c for c in D16_COLS[:7]]
    parts = [f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM tx" for c in tx_cols]
    parts += [f"SELECT '{c}', CAST({c} AS VARCHAR) FROM merchants" for c in ["BUSINESS_TYPE", "MCC_CODE", "OUTLET_TYPE"]]
    parts += ["SELECT 'SEGMENT', SEGMENT FROM customers"]
    u = " UNION ".join(parts)
    return f"""
WITH d AS (SELECT DISTINCT column_name, value FROM ({u}) WHERE value IS NOT NULL)
SELECT column_name AS "column", COUNT(*) AS n_distinct, MIN(value) AS first_value, MAX(value) AS last_value,
  CASE WHEN COUNT(*) <= 20 THEN array_to_string(list_sort(list(value)), '|') END AS "values"
FROM d GROUP BY column_name"""


@query("d16_distinct_values", _d16_sql())
def d16_distinct_values(spark, sf):
    """D16 distinct values per categorical column over three tables (A5 one-scan form, G2 union+distinct)."""
    v = views(spark, sf)
    return P.distinct_values({"transactions": v["transactions"], "merchants": v["merchants"],
                              "customers": v["customers"]}, D16_COLS)


@query("d17_compromised_terminals", f"""
SELECT MERCHANT_ID, {RATE} FROM ltx GROUP BY MERCHANT_ID HAVING COUNT(*) >= 5 AND AVG(TX_FRAUD) >= 0.5""")
def d17_compromised_terminals(spark, sf):
    d = P.compromised_entities(ltx(spark, sf), "MERCHANT_ID", min_count=5, threshold=0.5)
    return _rate_cols(d, "MERCHANT_ID")


@query("d18_spatial_cells", """
WITH bad AS (SELECT MERCHANT_ID FROM ltx GROUP BY MERCHANT_ID HAVING COUNT(*) >= 5 AND AVG(TX_FRAUD) >= 0.5),
j AS (SELECT t.*, round(x_customer_id / 10) AS cx, round(y_customer_id / 10) AS cy
      FROM ltx t JOIN customers USING (CUSTOMER_ID) WHERE MERCHANT_ID NOT IN (SELECT MERCHANT_ID FROM bad))
SELECT cx, cy, COUNT(*) AS n_tx, ROUND(AVG(TX_FRAUD), 6) AS fraud_rate, ROUND(ln(1 + AVG(TX_FRAUD)), 6) AS log_fraud_rate
FROM j GROUP BY cx, cy HAVING COUNT(*) >= 3""")
def d18_spatial_cells(spark, sf):
    v = views(spark, sf, "lineitem")
    t = v["transactions"].join(v["customers"], "CUSTOMER_ID")
    t = t.withColumns({"cx": F.round(F.col("x_customer_id") / 10), "cy": F.round(F.col("y_customer_id") / 10)})
    bad = P.compromised_entities(v["transactions"], "MERCHANT_ID", min_count=5, threshold=0.5)
    d = P.spatial_cells(t, "cx", "cy", exclude=bad, key="MERCHANT_ID")
    return d.select("cx", "cy", "n_tx", r("fraud_rate").alias("fraud_rate"), r("log_fraud_rate").alias("log_fraud_rate"))


@query("d19_terminal_heat_counts", """
SELECT t.TERMINAL_ID, x_terminal_id, y_terminal_id, COALESCE(n_tx, 0) AS n_tx, COALESCE(n_fraud, 0) AS n_fraud
FROM terminals t LEFT JOIN (SELECT TERMINAL_ID, COUNT(*) AS n_tx, CAST(SUM(TX_FRAUD) AS BIGINT) AS n_fraud FROM ltx GROUP BY 1) a
USING (TERMINAL_ID)""")
def d19_terminal_heat_counts(spark, sf):
    from frauddeck.operators.star import dim_with_fact_counts
    v = views(spark, sf, "lineitem")
    return dim_with_fact_counts(v["terminals"], v["transactions"], "TERMINAL_ID")


FLAG_SQL = {
    "is_night": "CAST(hour(TX_TS) >= 22 OR hour(TX_TS) <= 6 AS INTEGER)",
    "is_weekend": "CAST(isodow(TX_TS) - 1 IN (5, 6) AS INTEGER)",
    "has_cashback": "COALESCE(CAST(TRANSACTION_CASHBACK_AMOUNT > 0 AS INTEGER), 0)",
    "is_refund": "COALESCE(CAST(TRANSACTION_TYPE = 'Refund' AS INTEGER), 0)",
    "is_round_amount": "CAST(fmod(TX_AMOUNT, 10) = 0 AS INTEGER)",
}


def _flags(df):
    return df.select("TX_FRAUD", S.is_night(F.hour("TX_TS")).alias("is_night"), S.is_weekend("TX_TS").alias("is_weekend"),
                     S.cashback_features("TX_AMOUNT", "TRANSACTION_GOODS_AND_SERVICES_AMOUNT",
                                         "TRANSACTION_CASHBACK_AMOUNT")["has_cashback"].alias("has_cashback"),
                     S.eq_flag("TRANSACTION_TYPE", "Refund").alias("is_refund"),
                     S.round_flags("TX_AMOUNT")["is_round_amount"].alias("is_round_amount"))


@query("d20_conditional_rates", " UNION ALL ".join(
    f"""SELECT '{f}' AS flag, ROUND(AVG(CASE WHEN {e} = 1 THEN TX_FRAUD END), 6) AS rate_when_1,
      ROUND(AVG(CASE WHEN {e} = 0 THEN TX_FRAUD END), 6) AS rate_when_0,
      CAST(SUM(CASE WHEN {e} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_when_1 FROM ltx""" for f, e in FLAG_SQL.items()))
def d20_conditional_rates(spark, sf):
    d = P.conditional_rates(_flags(ltx(spark, sf)), list(FLAG_SQL))
    return d.select("flag", r("rate_when_1").alias("rate_when_1"), r("rate_when_0").alias("rate_when_0"), "n_when_1")


CORR_FEATS = {"TX_AMOUNT": "TX_AMOUNT", "TRANSACTION_CASHBACK_AMOUNT": "TRANSACTION_CASHBACK_AMOUNT",
              "TRANSACTION_GOODS_AND_SERVICES_AMOUNT": "TRANSACTION_GOODS_AND_SERVICES_AMOUNT",
              "x_customer_id": "x_customer_id", "y_customer_id": "y_customer_id",
              "x_terminal_id": "x_terminal_id", "y_terminal_id": "y_terminal_id",
              "ANNUAL_TURNOVER": "ANNUAL_TURNOVER", "AVERAGE_TICKET_SALE_AMOUNT": "AVERAGE_TICKET_SALE_AMOUNT"}


def _student_sql(c: str, n: str) -> str:
    """The two-sided tail by the finite sums for even and odd degrees of freedom (another way than the
    library's continued fraction)."""
    rr = f"(1 - {c} * {c})"
    even = f"list_sum(list_transform(range(0, ({n} - 2) // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1.0) + k * ln({rr})))) * abs({c}) / sqrt(pi())"
    odd = (f"(asin(abs({c})) + abs({c}) * sqrt({rr}) * list_sum(list_transform(range(0, ({n} - 3) // 2), "
           f"lambda k: exp(lgamma(k + 1.0) - lgamma(k + 1.5) + k * ln({rr})))) * sqrt(pi()) / 2) * 2 / pi()")
    return f"1 - CASE WHEN {n} % 2 = 0 THEN {even} ELSE {odd} END"


@query("d21_label_correlations", f"SELECT feature, ROUND(c, 6) AS correlation, ROUND(abs(c), 6) AS abs_correlation, n, ROUND({_student_sql('c', 'n')}, 6) AS p_value FROM (" + " UNION ALL ".join(
    f"""SELECT '{f}' AS feature, corr(COALESCE(CAST({e} AS DOUBLE), 0), CAST(TX_FRAUD AS DOUBLE)) AS c, COUNT(*) AS n
      FROM {STAR.replace('tx ', 'ltx ', 1)} HAVING COUNT({e}) > 100""" for f, e in CORR_FEATS.items()) + ")")
def d21_label_correlations(spark, sf):
    d = P.label_correlations(joined(spark, sf, "lineitem"), list(CORR_FEATS))
    return d.select("feature", r("correlation").alias("correlation"), r("abs_correlation").alias("abs_correlation"), "n", r("p_value").alias("p_value"))


@query("d22_top5pct_amount_flag", """
SELECT TX_ID, CAST(TX_AMOUNT > (SELECT quantile_cont(TX_AMOUNT, 0.95) FROM tx) AS INTEGER) AS is_top_pct,
  ROUND((SELECT quantile_cont(TX_AMOUNT, 0.95) FROM tx), 6) AS is_top_pct_cutoff FROM tx""")
def d22_top5pct_amount_flag(spark, sf):
    d = P.percentile_flag(tx(spark, sf), "TX_AMOUNT", 0.95)
    return d.select("TX_ID", "is_top_pct", r("is_top_pct_cutoff").alias("is_top_pct_cutoff"))


@query("d23_describe_scores", """
SELECT COUNT(TX_FRAUD) AS count, ROUND(AVG(TX_FRAUD), 6) AS mean, ROUND(stddev_samp(TX_FRAUD), 6) AS std,
  ROUND(MIN(TX_FRAUD), 6) AS min, ROUND(quantile_cont(TX_FRAUD, 0.25), 6) AS p25, ROUND(quantile_cont(TX_FRAUD, 0.5), 6) AS p50,
  ROUND(quantile_cont(TX_FRAUD, 0.75), 6) AS p75, ROUND(MAX(TX_FRAUD), 6) AS max FROM scores_a""")
def d23_describe_scores(spark, sf):
    d = P.describe(adapter.scores_a(tx(spark, sf)), "TX_FRAUD")
    return d.select("count", *[r(c).alias(c) for c in ["mean", "std", "min", "p25", "p50", "p75", "max"]])


@query("d23_score_value_counts", """
SELECT CAST(TX_FRAUD >= 0.5 AS INTEGER) AS pred, COUNT(*) AS n FROM scores_a GROUP BY 1""")
def d23_score_value_counts(spark, sf):
    s = adapter.scores_a(tx(spark, sf))
    return s.groupBy(S.binarise("TX_FRAUD").alias("pred")).agg(F.count(F.lit(1)).alias("n"))


@query("d24_mean_score_by_type", """
SELECT TRANSACTION_TYPE, ROUND(AVG(s.TX_FRAUD), 6) AS mean_score, COUNT(*) AS n
FROM tx JOIN scores_a s USING (TX_ID) GROUP BY 1""")
def d24_mean_score_by_type(spark, sf):
    t = tx(spark, sf)
    j = t.select("TX_ID", "TRANSACTION_TYPE").join(adapter.scores_a(t).withColumnRenamed("TX_FRAUD", "score"), "TX_ID")
    return P.mean_by(j, "TRANSACTION_TYPE", "score").select("TRANSACTION_TYPE", r("mean_score").alias("mean_score"), "n")


@query("d24_mean_score_by_hour", """
SELECT CAST(hour(TX_TS) AS BIGINT) AS hour, ROUND(AVG(s.TX_FRAUD), 6) AS mean_score, COUNT(*) AS n
FROM tx JOIN scores_a s USING (TX_ID) GROUP BY 1""")
def d24_mean_score_by_hour(spark, sf):
    t = tx(spark, sf)
    j = t.select("TX_ID", "TX_TS").join(adapter.scores_a(t).withColumnRenamed("TX_FRAUD", "score"), "TX_ID")
    return P.mean_by(j, {"hour": F.hour("TX_TS").cast("bigint")}, "score").select(
        "hour", r("mean_score").alias("mean_score"), "n")


@query("d25_prediction_summary", """
SELECT COUNT(*) AS n_total, CAST(SUM(CASE WHEN p = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_neg,
  CAST(SUM(CASE WHEN p = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_pos, ROUND(AVG(CASE WHEN p = 1 THEN 1.0 ELSE 0.0 END) * 100, 6) AS pos_rate_pct
FROM (SELECT CAST(TX_FRAUD >= 0.5 AS INTEGER) AS p FROM scores_a)""")
def d25_prediction_summary(spark, sf):
    s = adapter.scores_a(tx(spark, sf)).select(S.binarise("TX_FRAUD").alias("p"))
    d = P.prediction_summary(s, "p")
    return d.select("n_total", "n_neg", "n_pos", r("pos_rate_pct").alias("pos_rate_pct"))


@query("d26_score_moments", """
SELECT ROUND(AVG(TX_FRAUD), 6) AS mean, ROUND(MAX(TX_FRAUD), 6) AS max, ROUND(stddev_samp(TX_FRAUD), 6) AS std FROM scores_b""")
def d26_score_moments(spark, sf):
    d = P.score_moments(adapter.scores_b(tx(spark, sf)), "TX_FRAUD")
    return d.select(*[r(c).alias(c) for c in ["mean", "max", "std"]])


@query("d27_fraud_amount_moments", """
SELECT ROUND(AVG(TX_AMOUNT), 6) AS mu, ROUND(stddev_pop(TX_AMOUNT), 4) AS sigma, MIN(TX_AMOUNT) AS lo,
  MAX(TX_AMOUNT) AS hi, COUNT(*) AS n FROM ltx WHERE TX_FRAUD = 1""")
def d27_fraud_amount_moments(spark, sf):
    d = P.positive_amount_moments(ltx(spark, sf))
    return d.select(r("mu").alias("mu"), r("sigma", 4).alias("sigma"), "lo", "hi", "n")


@query("d27_truncated_normal")
def d27_truncated_normal(spark, sf):
    """The normal, cut to the observed range, that fits the fraud amounts best."""
    from frauddeck.operators.tails import truncated_normal
    return truncated_normal(ltx(spark, sf))


@query("f3_scores_sorted", """
SELECT TX_ID, ROUND(TX_FRAUD, 6) AS TX_FRAUD, row_number() OVER (ORDER BY TX_FRAUD DESC, TX_ID) AS place FROM scores_b""")
def f3_scores_sorted(spark, sf):
    """the whole score file in descending order, each row with its place (distributed ranks)."""
    from frauddeck.operators.globalrank import row_number_within
    s = adapter.scores_b(tx(spark, sf))
    d = row_number_within(s, [], [F.col("TX_FRAUD").desc(), F.col("TX_ID")], out="place")
    return d.orderBy("place").select("TX_ID", r("TX_FRAUD").alias("TX_FRAUD"), F.col("place").cast("bigint").alias("place"))


@query("f4_top100_scores", """
SELECT TX_ID, ROUND(TX_FRAUD, 6) AS TX_FRAUD FROM scores_b ORDER BY TX_FRAUD DESC, TX_ID LIMIT 100""")
def f4_top100_scores(spark, sf):
    """a top-n report."""
    s = adapter.scores_b(tx(spark, sf))
    return P.top_n(s, [F.col("TX_FRAUD").desc(), F.col("TX_ID")], 100).select("TX_ID", r("TX_FRAUD").alias("TX_FRAUD"))


@query("f4_top_features_by_abs_corr", " UNION ALL ".join(
    f"""SELECT * FROM (SELECT '{f}' AS feature, ROUND(abs(corr(COALESCE(CAST({e} AS DOUBLE), 0), CAST(TX_FRAUD AS DOUBLE))), 6)
      AS abs_correlation FROM {STAR})""" for f, e in CORR_FEATS.items())
    .join(["SELECT * FROM (", ") ORDER BY abs_correlation DESC, feature LIMIT 10"]).join(["SELECT * FROM (", ") WHERE abs_correlation > 0.01"]))
def f4_top_features_by_abs_corr(spark, sf):
    d = P.label_correlations(joined(spark, sf), list(CORR_FEATS), min_non_null=0)
    best = P.top_n(d, [F.col("abs_correlation").desc(), F.col("feature")], 10)  # of the ten best, those above 0.01
    return best.select("feature", r("abs_correlation").alias("abs_correlation")).filter("abs_correlation > 0.01")


@query("g1_union_train_validation", """
SELECT TX_ID, 'train' AS part FROM tx WHERE TX_TS < TIMESTAMP '2024-01-25'
UNION ALL SELECT TX_ID, 'valid' AS part FROM tx WHERE TX_TS >= TIMESTAMP '2024-01-25'""")
def g1_union_train_validation(spark, sf):
    """G1 row union."""
    t = tx(spark, sf)
    cut = F.lit("2024-01-25 00:00:00").cast("timestamp")
    a = t.filter(F.col("TX_TS") < cut).select("TX_ID", F.lit("train").alias("part"))
    b = t.filter(F.col("TX_TS") >= cut).select("TX_ID", F.lit("valid").alias("part"))
    return a.unionByName(b)


@query("g3_concat_feature_blocks", f"""
SELECT tx.TX_ID, ROUND(TX_AMOUNT, 6) AS TX_AMOUNT, CAST(hour(TX_TS) AS BIGINT) AS hour, ROUND({DIST_SQL}, 6) AS distance,
  ROUND(TX_AMOUNT / COUNT(*) OVER (PARTITION BY CUSTOMER_ID), 6) AS amount_per_tx FROM tx
LEFT JOIN customers USING (CUSTOMER_ID) LEFT JOIN terminals USING (TERMINAL_ID)""")
def g3_concat_feature_blocks(spark, sf):
    """Numeric, calendar, distance and customer blocks, each from its own source, side by side."""
    from frauddeck.operators.star import concat_blocks, star_join
    v = views(spark, sf)
    t = v["transactions"]
    placed = star_join(t.select("TX_ID", "CUSTOMER_ID", "TERMINAL_ID"), v["customers"], v["terminals"])
    per = t.join(t.groupBy("CUSTOMER_ID").agg(F.count(F.lit(1)).alias("_n")), "CUSTOMER_ID")
    return concat_blocks([t.select("TX_ID", r("TX_AMOUNT").alias("TX_AMOUNT")), t.select("TX_ID", F.hour("TX_TS").cast("bigint").alias("hour")),
                          placed.select("TX_ID", r(S.distance("x_customer_id", "y_customer_id", "x_terminal_id", "y_terminal_id")).alias("distance")),
                          per.select("TX_ID", r(F.col("TX_AMOUNT") / F.col("_n")).alias("amount_per_tx"))])


@query("f2_total_time_order", """
SELECT TX_ID, epoch_us(TX_TS) AS TX_TS_us, row_number() OVER (ORDER BY TX_TS, TX_ID) AS time_rank FROM ltx""")
def f2_total_time_order(spark, sf):
    """total order by time as an explicit rank (distributed, not a single-task window)."""
    from frauddeck.operators.globalrank import row_number_within
    d = row_number_within(ltx(spark, sf).select("TX_ID", "TX_TS"), [], [F.col("TX_TS"), F.col("TX_ID")], out="time_rank")
    return d.select("TX_ID", F.unix_micros("TX_TS").alias("TX_TS_us"), F.col("time_rank").cast("bigint").alias("time_rank"))


@query("a9_sample_exact_n")
def a9_sample_exact_n(spark, sf):
    """A repeatable sample of exactly 500 transactions (the sample is the feature)."""
    from frauddeck.sources.io import sample_exact
    return sample_exact(tx(spark, sf), 500, seed=42).select("TX_ID", "CUSTOMER_ID", r("TX_AMOUNT").alias("TX_AMOUNT"))


@query("d4_rate_by_mcc_min_support_10", f"""
SELECT MCC_CODE, {RATE} FROM tx LEFT JOIN merchants USING (MERCHANT_ID)
WHERE MCC_CODE IS NOT NULL GROUP BY MCC_CODE HAVING COUNT(*) >= 10""")
def d4_rate_by_mcc_min_support_10(spark, sf):
    """D4 star join + fraud rate per merchant category with minimum support 10 (smoke entry)."""
    v = views(spark, sf)
    from frauddeck.operators.star import star_join
    j = star_join(v["transactions"], merchants=v["merchants"])
    return _rate_cols(P.rate_by(j, "MCC_CODE", min_count=10), "MCC_CODE")
