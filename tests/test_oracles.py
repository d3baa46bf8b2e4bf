"""Every query runs, and gives the rows of its SQL, at the smallest scale."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        path = f"{DATA}/{f}"
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def rows(frame) -> list[str]:
    frame = frame[sorted(frame.columns)]

    def plain(x):
        if hasattr(x, "item"):
            x = x.item()
        if x is None or isinstance(x, float) and math.isnan(x) or type(x).__name__ in ("NAType", "NaTType"):
            return None
        return round(x, 9) + 0.0 if isinstance(x, float) else list(map(plain, x)) if isinstance(x, (list, tuple)) else x

    return sorted(repr([plain(x) for x in r]) for r in frame.itertuples(index=False))


SQL = __spark_entry__.oracle_sql()
NAMES = [n for n in __spark_entry__.queries() if n in SQL and not n.startswith("op") and n != "pipeline"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    got, want = __spark_entry__.queries()[name](spark, DATA).toPandas(), con.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", [n for n in __spark_entry__.queries() if n not in SQL and not n.startswith("op") and n != "pipeline"])
def test_query_without_sql_runs(spark, name):
    assert __spark_entry__.queries()[name](spark, DATA).count() > 0 or name == "exclusions"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
