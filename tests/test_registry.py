import glob

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
# a cross-section that runs in seconds; the full comparison runs outside the tests
NAMES = ["call_edges_all", "entity_rows", "statement_nesting", "layout_paths", "line_format", "copybook_expansion", "reachable",
         "vector_topk_batch", "filled_prompts", "compare_rows", "literal_rows", "constraint_violations", "entity_upsert"]


def test_every_query_has_sql():
    # the training-data operators have tests of their own, and not all of them can be said in SQL
    without = set(entry.queries()) - set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(name == "pipeline" or name.startswith("op") for name in without)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {path.rsplit('/', 1)[1][:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    text = lambda v: None if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)
    mine = sorted((tuple(text(r[c]) for c in columns) for r in got.collect()), key=str)
    table = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in table.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(text(row[names.index(c)]) for c in columns) for row in table.fetchall()), key=str)
    assert mine == theirs


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["program", "deps"] and df.count() > 0
