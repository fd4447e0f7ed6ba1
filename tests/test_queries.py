"""Every registered query: against its SQL where there is one, else that it gives rows of its schema."""

import pytest

from corvine import registry

from .compare import reference, rows


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    assert len(set(df.columns)) == len(df.columns)
    found = df.toPandas()
    if name in registry.ORACLES:
        expected = reference(registry.ORACLES[name], sf)
        assert sorted(found.columns) == sorted(expected.columns)
        assert rows(found) == rows(expected)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
