"""Every registered query against its DuckDB SQL on the smallest tables."""

import pytest

from framewright.plans import catalog

from .oracle import same

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf_dir, name):
    same(QUERIES[name](spark, sf_dir), SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_imports():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
