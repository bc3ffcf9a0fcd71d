import math
import os
from collections import Counter

import duckdb
import pytest
from conftest import SMALL

import __spark_entry__
from marlstone.plans import catalog, problems

CORE = catalog.QUERIES | problems.QUERIES


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return v if v is None else str(v)


@pytest.fixture(scope="session")
def views():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SMALL}/{f}')")
    return con


def agree(spark, views, f, sql):
    df = f(spark, SMALL)
    names = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    if sql is None:
        assert got
        return
    cur = views.execute(sql)
    at = [[d[0] for d in cur.description].index(c) for c in names]
    assert len(cur.description) == len(names)
    assert got == Counter(tuple(plain(r[i]) for i in at) for r in cur.fetchall())


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, views, name):
    agree(spark, views, CORE[name], (catalog.ORACLE | problems.ORACLE).get(name))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    names = __spark_entry__.queries()
    assert set(CORE) <= set(names) and set(__spark_entry__.oracle_sql()) <= set(names)
