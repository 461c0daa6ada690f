"""Driver contract: every oracle belongs to a registered query; entry runs."""

import __spark_entry__ as E


def test_registry_shapes():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert all(callable(f) for f in qs.values())
    assert all(isinstance(v, str) and "SELECT" in v.upper() for v in sql.values())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["conv_id", "idx", "role", "confidence", "content"]
    assert df.count() > 0
