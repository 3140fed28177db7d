"""Every registered core query against its SQL on the smallest tables."""

import duckdb
import pytest

from plexus import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(tables):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{tables}/{t}.parquet'")
    return con


def plain(rows, columns, names):
    def value(x):
        return round(x, 5) if isinstance(x, float) else x

    return sorted((tuple(value(r[columns.index(n)]) for n in names) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, duck, tables, name):
    got = catalog.queries()[name](spark, tables)
    want = duck.sql(catalog.oracle_sql()[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    assert plain([tuple(r) for r in got.collect()], got.columns, names) == plain(want.fetchall(), list(want.columns), names)


def test_entry_and_registration(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
