"""Every query with SQL agrees with DuckDB over the small tables."""

import os

import duckdb
import pytest

from chronobin import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df):
    k = sorted(df.columns)
    return sorted(tuple(None if x is None or x != x else x for x in r) for r in df[k].astype(object).itertuples(index=False)) if not df[k].isna().any().any() else sorted(map(repr, ([None if x != x or x is None else x for x in r] for r in df[k].astype(object).where(df[k].notna(), None).itertuples(index=False))))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query(spark, name):
    got, want = core.queries()[name](spark, SF).toPandas(), connection().sql(core.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_sql():
    assert set(core.queries()) == set(core.oracle_sql())


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(core.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
