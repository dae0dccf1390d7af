"""Every query with SQL gives DuckDB's rows."""

import os
from collections import Counter

import duckdb
import pytest

from sawmill.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are absent")


def rows(frame):
    def plain(v):
        if v is None or v != v:
            return None
        if isinstance(v, float) or type(v).__name__.startswith("float"):
            return round(float(v), 9)
        return str(v)

    frame = frame[sorted(frame.columns)].astype(object)
    return Counter(tuple(plain(v) for v in r) for r in frame.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set TimeZone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equal_rows(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_others_run(spark, name):
    catalog.QUERIES[name](spark, SF).collect()
