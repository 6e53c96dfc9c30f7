import pytest

from compare import spark_rows, sql_rows
from foliant.plans import registry


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_matches_sql(spark, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    got = spark_rows(df)
    assert got
    if name in registry.SQL:
        columns, want = sql_rows(registry.SQL[name], sf_dir)
        assert sorted(df.columns) == columns
        assert got == want


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
