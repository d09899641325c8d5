import __spark_entry__ as entry
from fieldlake.plans import catalog


def test_every_query_has_a_check():
    assert set(catalog.ORACLES) == set(catalog.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_runs(spark):
    rows = entry.entry(spark).collect()
    assert rows and sum(r["n"] for r in rows) > 0
