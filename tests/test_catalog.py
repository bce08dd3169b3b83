"""Every query against its DuckDB twin on the small tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from siltstone.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        if glob.glob(path):
            c.sql(f"create view {t} as select * from read_parquet('{path}')")
    return c


def rows(df, columns):
    cell = lambda v: "null" if pd.isna(v) else repr(float(v)) if not isinstance(v, (str, bool)) else str(v)
    return sorted(tuple(cell(v) for v in r) for r in df[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, duck, name):
    got, want = catalog.queries()[name](spark, sf).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_entry(spark):
    import __spark_entry__ as entry

    assert sum(r.target for r in entry.entry(spark).collect()) == 1000
    assert set(entry.oracle_sql()) <= set(entry.queries())
