"""Every catalogue query against its SQL on the smallest tables."""

import duckdb
import pytest

from docloom.plans.catalogue import CATALOGUE

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "events", "labels", "conversations"):
        found.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return found


@pytest.mark.parametrize("name", CATALOGUE)
def test_matches_sql(spark, con, name):
    query, sql = CATALOGUE[name]
    got, want = query(spark, DIR), con.execute(sql)
    names = sorted(c[0] for c in want.description)
    assert sorted(got.columns) == names
    order = [[c[0] for c in want.description].index(n) for n in names]
    rows = sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())
    assert sorted(repr(tuple(r)) for r in got.select(*names).collect()) == rows
