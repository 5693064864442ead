"""Registered queries: encoders, splits, folds, weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from frauddeck.operators import encode as E, split as J
from frauddeck.plans.catalog import query
from frauddeck.plans.common import joined, r, tx
from frauddeck.sources import adapter
from frauddeck.operators.attach import attach_row

CUT = "TIMESTAMP '2024-01-20'"
TRTE = f"tr AS (SELECT * FROM tx WHERE TX_TS < {CUT}), te AS (SELECT * FROM tx WHERE TX_TS >= {CUT})"
# integer shuffle key the oracle can reproduce (no shared hash function between engines)
SHUF_SQL = "(TX_ID * 7919 + 104729) % 1000003"


def _shuf():
    return (F.col("TX_ID") * 7919 + 104729) % 1000003


def _train_test(spark, sf):
    t = tx(spark, sf)
    cut = F.lit("2024-01-20 00:00:00").cast("timestamp")
    return t.filter(F.col("TX_TS") < cut), t.filter(F.col("TX_TS") >= cut)


OH_COLS = {"TRANSACTION_TYPE": adapter.TX_TYPES, "CARD_BRAND": adapter.CARD_BRANDS,
           "ACQUIRER_ID": [f"ACQ{i}" for i in range(1, 7)]}


def _oh_sql():
    cols = []
    for c, levels in OH_COLS.items():
        for lv in sorted(levels):
            cols.append(f"""CAST(COALESCE(CAST({c} AS VARCHAR), 'unknown') = '{lv}' AS INTEGER) AS "{c.lower()}_{lv}" """)
    return f"SELECT TX_ID, {', '.join(cols)} FROM tx"


@query("i1_one_hot", _oh_sql())
def i1_one_hot(spark, sf):
    t = tx(spark, sf).select("TX_ID", *OH_COLS)
    return E.one_hot(t, list(OH_COLS))


@query("i2_i3_i4_label_codes", f"""
WITH {TRTE},
m AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code
      FROM (SELECT DISTINCT COALESCE(CAST(MERCHANT_ID AS VARCHAR), '__NA__') AS v FROM tr)),
n AS (SELECT COUNT(*) AS n_classes FROM m)
SELECT TX_ID, COALESCE(code, -1) AS code_unseen_minus1, COALESCE(code, 0) AS code_unseen_first,
  COALESCE(code, n_classes) AS code_unseen_n
FROM te LEFT JOIN m ON COALESCE(CAST(te.MERCHANT_ID AS VARCHAR), '__NA__') = m.v, n""")
def i2_i3_i4_label_codes(spark, sf):
    tr, te = _train_test(spark, sf)
    tr = tr.withColumn("MERCHANT_ID", F.col("MERCHANT_ID").cast("string"))
    te = te.withColumn("MERCHANT_ID", F.col("MERCHANT_ID").cast("string"))
    m = E.fit_codes(tr.filter(F.col("TX_ID") % 3 != 0), "MERCHANT_ID") if False else E.fit_codes(tr, "MERCHANT_ID")
    d = E.apply_codes(te.select("TX_ID", "MERCHANT_ID"), "MERCHANT_ID", m, unseen="minus_one", out="code_unseen_minus1")
    d = E.apply_codes(d, "MERCHANT_ID", m, unseen="first", out="code_unseen_first")
    d = E.apply_codes(d, "MERCHANT_ID", m, unseen="n_classes", out="code_unseen_n")
    return d.select("TX_ID", "code_unseen_minus1", "code_unseen_first", "code_unseen_n")


@query("i2_label_codes_with_unseen", f"""
WITH tr AS (SELECT * FROM ltx WHERE TX_TS < TIMESTAMP '1996-06-01'), te AS (SELECT * FROM ltx WHERE TX_TS >= TIMESTAMP '1996-06-01'),
m AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code
      FROM (SELECT DISTINCT COALESCE(CAST(CUSTOMER_ID AS VARCHAR), '__NA__') AS v FROM tr)),
n AS (SELECT COUNT(*) AS n_classes FROM m)
SELECT TX_ID, COALESCE(code, -1) AS code_unseen_minus1, COALESCE(code, n_classes) AS code_unseen_n
FROM te LEFT JOIN m ON COALESCE(CAST(te.CUSTOMER_ID AS VARCHAR), '__NA__') = m.v, n""")
def i2_label_codes_with_unseen(spark, sf):
    from frauddeck.plans.common import ltx
    t = ltx(spark, sf).withColumn("CUSTOMER_ID", F.col("CUSTOMER_ID").cast("string"))
    cut = F.lit("1996-06-01 00:00:00").cast("timestamp")
    tr, te = t.filter(F.col("TX_TS") < cut), t.filter(F.col("TX_TS") >= cut)
    m = E.fit_codes(tr, "CUSTOMER_ID")
    d = E.apply_codes(te.select("TX_ID", "CUSTOMER_ID"), "CUSTOMER_ID", m, unseen="minus_one", out="code_unseen_minus1")
    d = E.apply_codes(d, "CUSTOMER_ID", m, unseen="n_classes", out="code_unseen_n")
    return d.select("TX_ID", "code_unseen_minus1", "code_unseen_n")


@query("i5_frequency_encoding", """
SELECT TX_ID, ROUND(COALESCE(f, 0), 6) AS mcc_frequency
FROM (SELECT TX_ID, MCC_CODE FROM tx LEFT JOIN merchants USING (MERCHANT_ID)) a
LEFT JOIN (SELECT MCC_CODE, COUNT(*) / (SELECT COUNT(MCC_CODE) FROM tx LEFT JOIN merchants USING (MERCHANT_ID)) AS f
           FROM tx LEFT JOIN merchants USING (MERCHANT_ID) WHERE MCC_CODE IS NOT NULL GROUP BY MCC_CODE) b USING (MCC_CODE)""")
def i5_frequency_encoding(spark, sf):
    j = joined(spark, sf).select("TX_ID", "MCC_CODE")
    d = E.frequency_encode(j, "MCC_CODE", "mcc_frequency")
    return d.select("TX_ID", r("mcc_frequency").alias("mcc_frequency"))


I6_COLS = ["TERMINAL_ID", "CARD_BRAND", "FAILURE_CODE"]


@query("i6_log_count_encoding", f"""
WITH {TRTE}
SELECT TX_ID, {", ".join(f'''ROUND(ln(1 + COALESCE((SELECT COUNT(*) FROM tr WHERE COALESCE(CAST(tr.{c} AS VARCHAR), '__NA__')
   = COALESCE(CAST(te.{c} AS VARCHAR), '__NA__')), 0)), 6) AS freq_{c}''' for c in I6_COLS)}
FROM te""")
def i6_log_count_encoding(spark, sf):
    tr, te = _train_test(spark, sf)
    d = E.log_count_encode(te.select("TX_ID", *I6_COLS), I6_COLS, reference=tr)
    return d.select("TX_ID", *[r(f"freq_{c}").alias(f"freq_{c}") for c in I6_COLS])


FOLD_SQL = f"""f AS (SELECT *, CAST((row_number() OVER (PARTITION BY TX_FRAUD ORDER BY {SHUF_SQL}, TX_ID) - 1) % 5 AS INTEGER) AS fold
   FROM j)"""


def _te_sql(alpha=None):
    if alpha is None:
        enc = "CASE WHEN o.n > 0 THEN o.s / o.n END"
    else:
        enc = f"CASE WHEN o.n > 0 THEN (o.s + {alpha} * g) / (o.n + {alpha}) END"
    return f"""
WITH j AS (SELECT TX_ID, TX_FRAUD, MCC_CODE FROM tx LEFT JOIN merchants USING (MERCHANT_ID)),
{FOLD_SQL},
pf AS (SELECT MCC_CODE, fold, SUM(CAST(TX_FRAUD AS DOUBLE)) AS fs, COUNT(TX_FRAUD) AS fn FROM f GROUP BY MCC_CODE, fold),
o AS (SELECT MCC_CODE, fold, SUM(fs) OVER (PARTITION BY MCC_CODE) - fs AS s, SUM(fn) OVER (PARTITION BY MCC_CODE) - fn AS n FROM pf),
gm AS (SELECT AVG(CAST(TX_FRAUD AS DOUBLE)) AS g FROM f)
SELECT TX_ID, f.fold, ROUND(COALESCE({enc}, g), 6) AS MCC_CODE_te
FROM f LEFT JOIN o ON f.MCC_CODE IS NOT DISTINCT FROM o.MCC_CODE AND f.fold = o.fold, gm"""


def _te(spark, sf, alpha=None):
    j = joined(spark, sf).select("TX_ID", "TX_FRAUD", "MCC_CODE")
    f = J.stratified_kfold(j, 5, shuffle_key=_shuf())
    d = E.out_of_fold_target_encode(f, "MCC_CODE", alpha=alpha)
    return d.select("TX_ID", "fold", r("MCC_CODE_te").alias("MCC_CODE_te"))


@query("i7_oof_target_encoding", _te_sql())
def i7_oof_target_encoding(spark, sf):
    return _te(spark, sf)


@query("i8_oof_target_encoding_smoothed", _te_sql(10))
def i8_oof_target_encoding_smoothed(spark, sf):
    return _te(spark, sf, alpha=10.0)


@query("i9_apply_target_encoding_to_test", f"""
WITH {TRTE},
j AS (SELECT TX_ID, TX_FRAUD, CARD_BRAND AS MCC_CODE FROM tr),
{FOLD_SQL},
pf AS (SELECT MCC_CODE, fold, SUM(CAST(TX_FRAUD AS DOUBLE)) AS fs, COUNT(TX_FRAUD) AS fn FROM f GROUP BY MCC_CODE, fold),
o AS (SELECT MCC_CODE, fold, SUM(fs) OVER (PARTITION BY MCC_CODE) - fs AS s, SUM(fn) OVER (PARTITION BY MCC_CODE) - fn AS n FROM pf),
gm AS (SELECT AVG(CAST(TX_FRAUD AS DOUBLE)) AS g FROM f),
enc AS (SELECT f.MCC_CODE, COALESCE(CASE WHEN o.n > 0 THEN o.s / o.n END, g) AS te FROM f
        LEFT JOIN o ON f.MCC_CODE = o.MCC_CODE AND f.fold = o.fold, gm),
per AS (SELECT MCC_CODE, AVG(te) AS te FROM enc GROUP BY 1)
SELECT TX_ID, ROUND(COALESCE(per.te, (SELECT AVG(CAST(TX_FRAUD AS DOUBLE)) FROM tr)), 6) AS CARD_BRAND_te
FROM (SELECT TX_ID, CASE WHEN TX_ID % 7 = 0 THEN 'Brand new' WHEN TX_ID % 7 = 1 THEN NULL ELSE CARD_BRAND END AS brand FROM te) t
LEFT JOIN per ON t.brand = per.MCC_CODE""")
def i9_apply_target_encoding_to_test(spark, sf):
    tr, te = _train_test(spark, sf)
    f = J.stratified_kfold(tr.select("TX_ID", "TX_FRAUD", "CARD_BRAND"), 5, shuffle_key=_shuf())
    enc = E.out_of_fold_target_encode(f, "CARD_BRAND")
    brand = F.when(F.col("TX_ID") % 7 == 0, "Brand new").when(F.col("TX_ID") % 7 != 1, F.col("CARD_BRAND"))  # unseen and null ones
    d = E.apply_target_encoding(te.select("TX_ID", brand.alias("CARD_BRAND")), enc, "CARD_BRAND")
    return d.select("TX_ID", r("CARD_BRAND_te").alias("CARD_BRAND_te"))


@query("i10_standard_scale_train_to_test", f"""
WITH {TRTE},
s AS (SELECT AVG(TX_AMOUNT) AS m, stddev_pop(TX_AMOUNT) AS sd, AVG(TRANSACTION_CASHBACK_AMOUNT) AS m2,
      stddev_pop(TRANSACTION_CASHBACK_AMOUNT) AS sd2 FROM tr)
SELECT TX_ID, ROUND((TX_AMOUNT - m) / (CASE WHEN sd = 0 OR sd IS NULL THEN 1 ELSE sd END), 6) AS TX_AMOUNT_z,
  ROUND(TX_AMOUNT, 6) AS TX_AMOUNT_back,
  ROUND((TRANSACTION_CASHBACK_AMOUNT - m2) / (CASE WHEN sd2 = 0 OR sd2 IS NULL THEN 1 ELSE sd2 END), 6) AS TRANSACTION_CASHBACK_AMOUNT_z
FROM te, s""")
def i10_standard_scale_train_to_test(spark, sf):
    tr, te = _train_test(spark, sf)
    cols = ["TX_AMOUNT", "TRANSACTION_CASHBACK_AMOUNT"]
    d = E.standard_scale(te.select("TX_ID", *cols), cols, fit_on=tr, suffix="_z")
    st = tr.agg(F.avg("TX_AMOUNT").alias("m"), F.stddev_pop("TX_AMOUNT").alias("s"))
    d = E.inverse_standard_scale(attach_row(d, st), "TX_AMOUNT_z", F.col("m"), F.col("s"), "TX_AMOUNT_back")
    return d.select("TX_ID", *[r(c + "_z").alias(c + "_z") for c in cols], r("TX_AMOUNT_back").alias("TX_AMOUNT_back"))


@query("i11_prepare_categoricals", """
SELECT TX_ID, COALESCE(CAST(FAILURE_CODE AS VARCHAR), 'MISSING') AS FAILURE_CODE,
  COALESCE(CAST(MCC_CODE AS VARCHAR), 'MISSING') AS MCC_CODE, COALESCE(CAST(TERMINAL_ID AS VARCHAR), 'MISSING') AS TERMINAL_ID
FROM tx LEFT JOIN merchants USING (MERCHANT_ID)""")
def i11_prepare_categoricals(spark, sf):
    j = joined(spark, sf).select("TX_ID", "FAILURE_CODE", "MCC_CODE", "TERMINAL_ID")
    return E.prepare_categoricals(j, ["FAILURE_CODE", "MCC_CODE", "TERMINAL_ID", "NOT_THERE"])


@query("j1_stratified_split", f"""
SELECT TX_ID, CAST(rn <= floor(n * 0.8) AS INTEGER) AS is_train FROM (
  SELECT TX_ID, row_number() OVER (PARTITION BY TX_FRAUD ORDER BY {SHUF_SQL}, TX_ID) AS rn,
         COUNT(*) OVER (PARTITION BY TX_FRAUD) AS n FROM tx)""")
def j1_stratified_split(spark, sf):
    d = J.stratified_split(tx(spark, sf).select("TX_ID", "TX_FRAUD"), shuffle_key=_shuf())
    return d.select("TX_ID", "is_train")


@query("j2_a10_time_split_validation", """
SELECT TX_ID, TX_FRAUD FROM (
  SELECT TX_ID, TX_FRAUD, row_number() OVER (ORDER BY TX_TS, TX_ID) AS rn, COUNT(*) OVER () AS n FROM ltx)
WHERE rn > floor(n * 0.8)""")
def j2_a10_time_split_validation(spark, sf):
    from frauddeck.plans.common import ltx
    d = J.time_split(ltx(spark, sf).select("TX_ID", "TX_TS", "TX_FRAUD"))
    return d.filter(F.col("is_train") == 0).select("TX_ID", "TX_FRAUD")


@query("j3_stratified_kfold", f"""
SELECT TX_ID, CAST((row_number() OVER (PARTITION BY TX_FRAUD ORDER BY {SHUF_SQL}, TX_ID) - 1) % 5 AS INTEGER) AS fold FROM tx""")
def j3_stratified_kfold(spark, sf):
    return J.stratified_kfold(tx(spark, sf).select("TX_ID", "TX_FRAUD"), 5, shuffle_key=_shuf()).select("TX_ID", "fold")


@query("j4_time_folds", """
WITH o AS (SELECT TX_ID, row_number() OVER (ORDER BY TX_TS, TX_ID) - 1 AS p, COUNT(*) OVER () AS n FROM ltx),
q AS (SELECT *, n // 5 AS q, n % 5 AS rem FROM o)
SELECT TX_ID, CAST(CASE WHEN p < rem * (q + 1) THEN p // (q + 1) ELSE rem + (p - rem * (q + 1)) // q END AS INTEGER) AS fold FROM q""")
def j4_time_folds(spark, sf):
    from frauddeck.plans.common import ltx
    return J.time_folds(ltx(spark, sf).select("TX_ID", "TX_TS"), 5).select("TX_ID", "fold")


@query("j5_class_weight", """
SELECT CAST(SUM(CASE WHEN TX_FRAUD = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_neg,
  CAST(SUM(CASE WHEN TX_FRAUD = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_pos,
  ROUND(GREATEST(SUM(CASE WHEN TX_FRAUD = 0 THEN 1 ELSE 0 END) / GREATEST(SUM(CASE WHEN TX_FRAUD = 1 THEN 1 ELSE 0 END), 1), 1.0) * 0.7, 6)
    AS scale_pos_weight FROM ltx""")
def j5_class_weight(spark, sf):
    from frauddeck.plans.common import ltx
    d = J.class_weight(ltx(spark, sf), factor=0.7)
    return d.select("n_neg", "n_pos", r("scale_pos_weight").alias("scale_pos_weight"))


@query("j6_sample_weights", """
SELECT TX_ID, ROUND(CASE WHEN TX_FRAUD = 1 THEN GREATEST((SELECT SUM(1 - TX_FRAUD) FROM tx) / GREATEST((SELECT SUM(TX_FRAUD) FROM tx), 1), 1.0)
  ELSE 1.0 END * CASE WHEN TX_AMOUNT >= 500 AND TX_AMOUNT <= 1000 THEN 2.0 ELSE 1.0 END, 6) AS weight FROM tx""")
def j6_sample_weights(spark, sf):
    from frauddeck.functions.scalars import band_weight
    d = J.with_class_weight_col(tx(spark, sf).select("TX_ID", "TX_FRAUD", "TX_AMOUNT"))
    return d.select("TX_ID", r(F.col("weight") * band_weight("TX_AMOUNT")).alias("weight"))
