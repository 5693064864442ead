"""DuckDB SQL twin of :mod:`frauddeck.sources.adapter` for the oracle check.

``with_view(body)`` prefixes a query with CTEs named ``tx``, ``customers``,
``terminals``, ``merchants`` (events fact) or ``ltx`` (lineitem fact).
"""

from __future__ import annotations


def _case(values, idx: str) -> str:
    parts = []
    for i, v in enumerate(values):
        lit = "NULL" if v is None else "'" + v.replace("'", "''") + "'"
        parts.append(f"WHEN {idx} = {i} THEN {lit}")
    return "CASE " + " ".join(parts) + " END"


def _decorate(src: str) -> str:
    from frauddeck.sources import adapter as A
    s, u = "_seed", "CUSTOMER_ID"
    return f"""SELECT TX_ID, TX_TS, CUSTOMER_ID, TERMINAL_ID, MERCHANT_ID, TX_AMOUNT, TX_FRAUD,
      _goods AS TRANSACTION_GOODS_AND_SERVICES_AMOUNT,
      _cashback AS TRANSACTION_CASHBACK_AMOUNT,
      lpad(CAST({s} % 14 AS VARCHAR), 2, '0') || '/' || lpad(CAST({s} % 5 + 23 AS VARCHAR), 2, '0') AS CARD_EXPIRY_DATE,
      CAST({u} % 4 + 3 AS VARCHAR) || '*****' || lpad(CAST(({u} * 37) % 10000 AS VARCHAR), 4, '0') AS CARD_DATA,
      {_case(A.CARD_BRANDS, f'{u} % 4')} AS CARD_BRAND,
      {_case(A.TX_TYPES, f'{s} % 4')} AS TRANSACTION_TYPE,
      {_case(A.TX_STATUSES, f'({s} // 4) % 4')} AS TRANSACTION_STATUS,
      CASE WHEN TX_FRAUD = 1 THEN 'E' || CAST({s} % 27 AS VARCHAR) END AS FAILURE_CODE,
      {_case(A.CURRENCIES, f'{u} % 11')} AS TRANSACTION_CURRENCY,
      {_case(A.COUNTRIES, f'{u} % 5')} AS CARD_COUNTRY_CODE,
      {_case(A.RECURRING, f'{s} % 3')} AS IS_RECURRING_TRANSACTION,
      'ACQ' || CAST({s} % 6 + 1 AS VARCHAR) AS ACQUIRER_ID,
      {_case(A.AUTH_METHODS, f'{s} % 5')} AS CARDHOLDER_AUTH_METHOD
    FROM {src}"""


def _grid(k: str, mult: int, add: int = 0) -> str:
    return f"CAST(({k} * {mult} + {add}) % 10000 AS DOUBLE) / 100.0"


def view_ctes() -> str:
    from frauddeck.sources import adapter as A
    ev_base = """SELECT event_id AS TX_ID, CAST(ts AS TIMESTAMP) AS TX_TS, user_id AS CUSTOMER_ID,
        CAST(json_extract_string(props, '$.k') AS BIGINT) AS TERMINAL_ID,
        (event_id * 7) % 200 AS MERCHANT_ID, value AS TX_AMOUNT,
        CAST(event_type = 'error' AS INTEGER) AS TX_FRAUD,
        value * 0.9 AS _goods,
        CASE WHEN event_id % 3 = 0 THEN value * 0.2 ELSE 0.0 END AS _cashback,
        event_id AS _seed
      FROM events"""
    li_base = """SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' ||
          CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) || '-' ||
          CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(ROUND(l_extendedprice * 100) AS BIGINT) AS VARCHAR) AS TX_ID,
        CAST(l_shipdate AS TIMESTAMP) AS TX_TS, o_custkey AS CUSTOMER_ID,
        l_suppkey AS TERMINAL_ID, l_partkey AS MERCHANT_ID, l_extendedprice AS TX_AMOUNT,
        CAST(l_returnflag = 'R' AS INTEGER) AS TX_FRAUD,
        l_extendedprice * (1 - l_discount) AS _goods,
        l_extendedprice * l_tax * 3 AS _cashback,
        l_orderkey * 8 + l_linenumber AS _seed
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
    return f"""WITH
tx AS ({_decorate('(' + ev_base + ')')}),
ltx AS ({_decorate('(' + li_base + ')')}),
customers AS (SELECT c_custkey AS CUSTOMER_ID, {_grid('c_custkey', 7919)} AS x_customer_id,
    {_grid('c_custkey', 104729)} AS y_customer_id, c_mktsegment AS SEGMENT FROM customer),
terminals AS (SELECT s_suppkey AS TERMINAL_ID, {_grid('s_suppkey', 7919, 13)} AS x_terminal_id,
    {_grid('s_suppkey', 104729, 17)} AS y_terminal_id FROM supplier),
merchants AS (SELECT p_partkey AS MERCHANT_ID, p_type AS BUSINESS_TYPE, p_brand AS MCC_CODE,
    p_name AS LEGAL_NAME,
    DATE '2010-01-01' + CAST((p_partkey * 37) % 5000 AS INTEGER) AS FOUNDATION_DATE,
    {_case(A.TAX_FLAGS, 'p_size % 8')} AS TAX_EXCEMPT_INDICATOR,
    {_case(A.OUTLETS, 'p_size % 3')} AS OUTLET_TYPE,
    p_retailprice * 600 AS ANNUAL_TURNOVER_CARD, p_retailprice * 1000 AS ANNUAL_TURNOVER,
    p_retailprice / 10 AS AVERAGE_TICKET_SALE_AMOUNT,
    CAST((p_size * 3) % 110 AS DOUBLE) AS PAYMENT_PERCENTAGE_FACE_TO_FACE,
    CAST((p_size * 7) % 101 AS DOUBLE) AS PAYMENT_PERCENTAGE_ECOM,
    CAST(p_size % 30 AS DOUBLE) AS PAYMENT_PERCENTAGE_MOTO,
    CAST((p_partkey * 13) % 60 AS DOUBLE) AS DEPOSIT_REQUIRED_PERCENTAGE,
    CAST((p_partkey * 17) % 60 AS DOUBLE) AS DEPOSIT_PERCENTAGE,
    CAST((p_partkey * 11) % 100 AS DOUBLE) AS DELIVERY_SAME_DAYS_PERCENTAGE,
    CAST((p_partkey * 19) % 60 AS DOUBLE) AS DELIVERY_OVER_TWO_WEEKS_PERCENTAGE
  FROM part),
scores_a AS (SELECT TX_ID, TX_AMOUNT / (TX_AMOUNT + 50.0) AS TX_FRAUD FROM tx),
scores_b AS (SELECT TX_ID, (CAST((TX_ID * 7919) % 1000 AS DOUBLE) + 0.5) / 1000.0 AS TX_FRAUD FROM tx)
"""


def with_view(body: str) -> str:
    b = body.strip()
    if b[:4].upper() == "WITH":
        return view_ctes().rstrip() + ",\n" + b[4:]
    return view_ctes() + b
