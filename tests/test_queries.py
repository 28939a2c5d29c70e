"""Every query with SQL gives the rows of that SQL in another engine."""

import glob
import os

import duckdb
import pytest

from palimpsest import queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_against_sql(spark, con, name):
    got = queries.queries()[name](spark, SF)
    want = con.execute(queries.oracle_sql()[name])
    columns = sorted(d[0] for d in want.description)
    assert sorted(got.columns) == columns
    place = [[d[0] for d in want.description].index(c) for c in columns]
    expected = sorted(str(tuple(r[i] for i in place)) for r in want.fetchall())
    assert sorted(str(tuple(r)) for r in got.select(*columns).collect()) == expected
    if name != "new_files":
        assert expected
