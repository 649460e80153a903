"""The driver contract: every query runs, and gives what its SQL gives, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from cairnkit.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the shared tables aren't here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, con, name):
    df = registry.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    assert got
    if name in registry.ORACLES:
        ran = con.execute(registry.ORACLES[name])
        names = [d[0] for d in ran.description]
        assert sorted(names) == columns
        want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in ran.fetchall()), key=str)
        assert got == want


def test_entry_and_registration(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1
    found = __spark_entry__.queries()
    assert registry.QUERIES.keys() <= found.keys() and __spark_entry__.oracle_sql().keys() <= found.keys()
