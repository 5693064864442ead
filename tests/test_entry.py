"""Driver contract: every registered query has a builder, oracles refer to registered names."""

import __spark_entry__ as E


def test_contract_shapes():
    q, o = E.queries(), E.oracle_sql()
    assert len(q) > 100
    assert set(o) <= set(q)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"MCC_CODE", "n_tx", "n_fraud", "fraud_rate"} <= set(df.columns)
