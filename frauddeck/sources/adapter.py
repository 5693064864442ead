"""Map the driver's TPC-H-like tables onto the payments star schema.

The library's operators take payments-shaped tables (transactions, customers, terminals,
merchants). The test tables carry no such schema, so this adapter derives one with plain
column expressions; every derived row comes from a real input row, so the work of every
query grows with the input.

Two fact tables are offered:

* ``events``    -> transactions with a unique integer ``TX_ID`` and unique timestamps;
* ``lineitem``  -> transactions joined with ``orders`` for the customer; ``TX_ID`` is the
  composite ``orderkey-linenumber-partkey-suppkey-quantity-cents`` (the key columns alone
  repeat at the smallest scale) and timestamps are day-granular, so ties are everywhere.

The same mapping is written as SQL in :mod:`frauddeck.plans.oracle` for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value lists used to decorate the synthetic payments rows (fixed values; the
# oracle SQL spells the same lists in the same order).
CARD_BRANDS = ["AMEX", "Discover", "MasterCard", "Visa"]
TX_TYPES = ["Purchase", "Refund", "Purchase with cashback", "Cash Advance/Withdrawal"]
TX_STATUSES = ["Authorized", "Captured", "Rejected", "Settled"]
CURRENCIES = ["AED", "CAD", "CHF", "CNY", "EUR", "GBP", "HKD", "JPY", "MDL", "RON", "USD"]
COUNTRIES = ["AE", "RO", "FI", "US", "GB"]
RECURRING = ["True", "False", "Fals"]
AUTH_METHODS = ["No CVM performed", "Signature", "Online PIN", "Offline PIN", "Offline enciphered PIN"]
OUTLETS = ["Ecommerce", "Face to Face", "Face to Face and Ecommerce"]
TAX_FLAGS = [" True ", "Fals", "Y", "n", "1", "maybe", "no", None]


def _pick(values: list, idx: Column) -> Column:
    """``values[idx]`` as a CASE chain (idx is a non-negative integer column)."""
    expr = None
    for i, v in enumerate(values):
        lit = F.lit(v) if v is not None else F.lit(None).cast("string")
        expr = F.when(idx == i, lit) if expr is None else expr.when(idx == i, lit)
    return expr


def _grid(key: Column, mult: int, add: int = 0) -> Column:
    return ((key * mult + add) % 10000).cast("double") / 100.0


def _decorate(base: DataFrame) -> DataFrame:
    """Add the categorical payment attributes from the integer ``_seed`` and customer id."""
    s, u = F.col("_seed"), F.col("CUSTOMER_ID")
    return base.select(
        "TX_ID", "TX_TS", "CUSTOMER_ID", "TERMINAL_ID", "MERCHANT_ID", "TX_AMOUNT", "TX_FRAUD",
        F.col("_goods").alias("TRANSACTION_GOODS_AND_SERVICES_AMOUNT"),
        F.col("_cashback").alias("TRANSACTION_CASHBACK_AMOUNT"),
        F.concat(F.lpad((s % 14).cast("string"), 2, "0"), F.lit("/"),
                 F.lpad((s % 5 + 23).cast("string"), 2, "0")).alias("CARD_EXPIRY_DATE"),
        F.concat((u % 4 + 3).cast("string"), F.lit("*****"),
                 F.lpad(((u * 37) % 10000).cast("string"), 4, "0")).alias("CARD_DATA"),
        _pick(CARD_BRANDS, u % 4).alias("CARD_BRAND"),
        _pick(TX_TYPES, s % 4).alias("TRANSACTION_TYPE"),
        _pick(TX_STATUSES, (s / 4).cast("bigint") % 4).alias("TRANSACTION_STATUS"),
        F.when(F.col("TX_FRAUD") == 1, F.concat(F.lit("E"), (s % 27).cast("string"))).alias("FAILURE_CODE"),
        _pick(CURRENCIES, u % 11).alias("TRANSACTION_CURRENCY"),
        _pick(COUNTRIES, u % 5).alias("CARD_COUNTRY_CODE"),
        _pick(RECURRING, s % 3).alias("IS_RECURRING_TRANSACTION"),
        F.concat(F.lit("ACQ"), (s % 6 + 1).cast("string")).alias("ACQUIRER_ID"),
        _pick(AUTH_METHODS, s % 5).alias("CARDHOLDER_AUTH_METHOD"),
    )


_PLANS: dict = {}


def _memo(fn):
    """Reuse the lazy DataFrame (a plan, not data) per session and input folder: queries
    share one analysed adapter plan instead of rebuilding it."""
    def wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (fn.__name__, id(spark._jsparkSession), sf_dir.rstrip("/"))
        if key not in _PLANS:
            _PLANS[key] = fn(spark, sf_dir)
        return _PLANS[key]
    wrapper.__name__ = fn.__name__
    wrapper.__doc__ = fn.__doc__
    return wrapper


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # the parquet timestamps are naive wall-clock UTC; every calendar / epoch feature assumes it
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@_memo
def transactions_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _read(spark, sf_dir, "events")
    v, e = F.col("value"), F.col("event_id")
    base = ev.select(
        e.alias("TX_ID"),
        F.col("ts").cast("timestamp").alias("TX_TS"),
        F.col("user_id").alias("CUSTOMER_ID"),
        F.get_json_object("props", "$.k").cast("bigint").alias("TERMINAL_ID"),
        ((e * 7) % 200).alias("MERCHANT_ID"),
        v.alias("TX_AMOUNT"),
        (F.col("event_type") == "error").cast("int").alias("TX_FRAUD"),
        (v * 0.9).alias("_goods"),
        F.when(e % 3 == 0, v * 0.2).otherwise(F.lit(0.0)).alias("_cashback"),
        e.alias("_seed"),
    )
    return _decorate(base)


@_memo
def transactions_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem")
    od = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    j = li.join(od, li.l_orderkey == od.o_orderkey, "inner")
    p = F.col("l_extendedprice")
    base = j.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint"),
                    F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("TX_ID"),
        F.col("l_shipdate").cast("timestamp").alias("TX_TS"),
        F.col("o_custkey").alias("CUSTOMER_ID"),
        F.col("l_suppkey").alias("TERMINAL_ID"),
        F.col("l_partkey").alias("MERCHANT_ID"),
        p.alias("TX_AMOUNT"),
        (F.col("l_returnflag") == "R").cast("int").alias("TX_FRAUD"),
        (p * (1 - F.col("l_discount"))).alias("_goods"),
        (p * F.col("l_tax") * 3).alias("_cashback"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("_seed"),
    )
    return _decorate(base)


@_memo
def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return _read(spark, sf_dir, "customer").select(
        k.alias("CUSTOMER_ID"), _grid(k, 7919).alias("x_customer_id"),
        _grid(k, 104729).alias("y_customer_id"), F.col("c_mktsegment").alias("SEGMENT"))


@_memo
def terminals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return _read(spark, sf_dir, "supplier").select(
        k.alias("TERMINAL_ID"), _grid(k, 7919, 13).alias("x_terminal_id"),
        _grid(k, 104729, 17).alias("y_terminal_id"))


@_memo
def merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, sz, pr = F.col("p_partkey"), F.col("p_size"), F.col("p_retailprice")
    pct = lambda c: c.cast("double")
    return _read(spark, sf_dir, "part").select(
        k.alias("MERCHANT_ID"),
        F.col("p_type").alias("BUSINESS_TYPE"),
        F.col("p_brand").alias("MCC_CODE"),
        F.col("p_name").alias("LEGAL_NAME"),
        F.date_add(F.lit("2010-01-01").cast("date"), ((k * 37) % 5000).cast("int")).alias("FOUNDATION_DATE"),
        _pick(TAX_FLAGS, sz % 8).alias("TAX_EXCEMPT_INDICATOR"),
        _pick(OUTLETS, sz % 3).alias("OUTLET_TYPE"),
        (pr * 600).alias("ANNUAL_TURNOVER_CARD"),
        (pr * 1000).alias("ANNUAL_TURNOVER"),
        (pr / 10).alias("AVERAGE_TICKET_SALE_AMOUNT"),
        pct((sz * 3) % 110).alias("PAYMENT_PERCENTAGE_FACE_TO_FACE"),
        pct((sz * 7) % 101).alias("PAYMENT_PERCENTAGE_ECOM"),
        pct(sz % 30).alias("PAYMENT_PERCENTAGE_MOTO"),
        pct((k * 13) % 60).alias("DEPOSIT_REQUIRED_PERCENTAGE"),
        pct((k * 17) % 60).alias("DEPOSIT_PERCENTAGE"),
        pct((k * 11) % 100).alias("DELIVERY_SAME_DAYS_PERCENTAGE"),
        pct((k * 19) % 60).alias("DELIVERY_OVER_TWO_WEEKS_PERCENTAGE"),
    )


def scores_a(tx: DataFrame) -> DataFrame:
    """First model's score file ``(TX_ID, TX_FRAUD)`` derived from the amount."""
    return tx.select("TX_ID", (F.col("TX_AMOUNT") / (F.col("TX_AMOUNT") + 50.0)).alias("TX_FRAUD"))


def scores_b(tx: DataFrame) -> DataFrame:
    """Second model's score file, a deterministic pseudo-random function of the id."""
    return tx.select("TX_ID", (((F.col("TX_ID") * 7919) % 1000 + 0.5) / 1000.0).alias("TX_FRAUD"))


def payments_view(spark: SparkSession, sf_dir: str, fact: str = "events") -> dict[str, DataFrame]:
    tx = (transactions_from_events if fact == "events" else transactions_from_lineitem)(spark, sf_dir)
    return {"transactions": tx, "customers": customers(spark, sf_dir),
            "terminals": terminals(spark, sf_dir), "merchants": merchants(spark, sf_dir)}
