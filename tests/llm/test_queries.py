from pathlib import Path

import duckdb
import pytest

from corpusmith.llm.queries import QUERIES, SQL
from tools_check import rows_of


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, data, con, name):
    got, want = QUERIES[name](spark, data).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_distinct_rows(spark, data, name):
    got = QUERIES[name](spark, data)
    n = got.count()
    assert n > 0 and (not name.endswith("_found") or got.distinct().count() == n)
