"""The driver's contract."""

import __spark_entry__ as entry


def test_names_match():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 60


def test_flagship(spark):
    assert entry.entry(spark).limit(5).count() == 5
