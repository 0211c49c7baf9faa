import __spark_entry__ as entry


def test_queries_and_sql_agree():
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
