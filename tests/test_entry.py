import __spark_entry__ as entry
from lexigrove.plans import catalog, oracles


def test_names_match():
    assert set(oracles.oracle_sql()) <= set(catalog.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["term", "token_id", "doc_count", "doc_id", "freq"] and df.count() > 0
