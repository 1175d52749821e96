"""Every registered query of the library runs; those with SQL agree with DuckDB."""

import pytest
from compare import connect, duck_rows, spark_rows

from vocalith.plans.registry import all_queries, all_sql

QUERIES, SQL = all_queries(), all_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    cols, got = spark_rows(QUERIES[name](spark, sf_dir))
    if name not in SQL:
        assert got
        return
    want_cols, want = duck_rows(con, SQL[name])
    assert cols == want_cols
    assert got == want


def test_entry_module(spark, sf_dir):
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(QUERIES) <= set(names)
    assert set(entry.oracle_sql()) <= set(names)
    assert entry.entry(spark).count() == 1
