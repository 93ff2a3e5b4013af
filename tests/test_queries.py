"""Every registered query of the engine against its SQL, and the shape of those without."""

import os

import duckdb
import pandas as pd
import pytest

from corpuslab.plans.registry import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if v is None or v is pd.NaT or v is pd.NA or v != v:
        return None
    if isinstance(v, bool) or isinstance(v, str):
        return v
    if hasattr(v, "isoformat"):
        return str(v)[:26]
    return round(float(v), 6) + 0.0


def rows(df):
    out = [tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None)]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    if name in ORACLE_SQL:
        want = duck.execute(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got.columns) > 0


def test_queries_without_sql_are_few():
    assert len(QUERIES) - len(ORACLE_SQL) <= 30


def test_entry_point(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
