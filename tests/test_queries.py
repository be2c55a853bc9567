"""Every registered query with SQL gives the rows that DuckDB gives for it."""

from __future__ import annotations

import pytest

from tidewake.plans import registry

SMALL = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


def plain(rows, names, columns):
    return sorted(tuple("" if r[names.index(c)] is None else repr(r[names.index(c)]) for c in columns) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    found = QUERIES[name](spark, SMALL)
    columns = sorted(found.columns)
    wanted = duck.execute(SQL[name])
    names = [d[0] for d in wanted.description]
    assert sorted(names) == columns
    assert plain(found.collect(), found.columns, columns) == plain(wanted.fetchall(), names, columns)


def test_queries_without_sql_give_rows(spark):
    for name in sorted(set(QUERIES) - set(SQL)):
        assert QUERIES[name](spark, SMALL).columns


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
