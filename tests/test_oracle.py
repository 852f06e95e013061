"""Every core query with SQL against DuckDB over the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from corpusmith.plans.catalog import QUERIES, SQL
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
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_every_query_is_compared():
    """By its own SQL, or by the facts that SQL states about it (which run the query itself)."""
    assert not [n for n in QUERIES if n not in SQL and f"{n}_facts" not in SQL]


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
