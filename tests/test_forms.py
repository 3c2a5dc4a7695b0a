import glob

import duckdb
import pytest

from copperline.plans import form_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {path.rsplit('/', 1)[1][:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(form_queries.QUERIES))
def test_form_query_equals_sql(spark, duck, name):
    got = form_queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    mine = sorted((tuple(str(r[c]) for c in columns) for r in got.collect()))
    table = duck.execute(form_queries.SQL[name])
    names = [d[0] for d in table.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(str(row[names.index(c)]) for c in columns) for row in table.fetchall())
    assert mine and mine == theirs
