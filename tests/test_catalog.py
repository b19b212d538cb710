"""Every query of the log against its SQL in DuckDB."""

import datetime
import decimal
from pathlib import Path

import duckdb
import pytest

from eventloom.plans import catalog, records  # noqa: F401

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return repr(round(value, 9))
    if isinstance(value, decimal.Decimal):
        return str(int(value)) if value == int(value) else str(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_gives_what_sql_gives(spark, duck, name):
    got = catalog.QUERIES[name](spark, str(DATA))
    columns = sorted(got.columns)
    want = duck.sql(catalog.SQL[name])
    names = list(want.columns)
    assert sorted(names) == columns
    left = sorted(tuple(plain(row[c]) for c in columns) for row in got.collect())
    right = sorted(tuple(plain(row[names.index(c)]) for c in columns) for row in want.fetchall())
    assert left == right


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, str(DATA)).count() > 0
