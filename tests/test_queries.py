"""Every registered query against its SQL in DuckDB on the smallest tables."""

import duckdb
import pytest

from cohortlens.fixtures import DRIVER_TABLES
from cohortlens.plans import catalog
from tools.check_sql import rows

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def test_names():
    assert set(SQL) <= set(QUERIES)
    assert len(QUERIES) > 200


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    got = rows(df.columns, df.collect())
    if name not in SQL:
        return
    cur = duck.execute(SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == rows(cols, cur.fetchall())
