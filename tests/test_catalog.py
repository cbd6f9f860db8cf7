"""Each query of the catalogue against its SQL in DuckDB."""

import math

import duckdb
import pytest

from keymere.plans import catalog_more, catalog_store  # noqa: F401  add their queries
from keymere.plans.catalog import QUERIES
from keymere.plans.catalog_sql import SQL

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations benchmark".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def rows(records):
    clean = lambda v: round(v, 6) if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(clean(v) for v in r) for r in records), key=repr)


def test_all_have_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DIR)
    want = duck.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(got.select(*names).collect()) == rows(want.fetchall())
