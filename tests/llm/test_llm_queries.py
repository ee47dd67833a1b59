import glob
import os

import duckdb
import pytest

from mnemospark.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    result = con.execute(queries.SQL[name])
    names = [d[0] for d in result.description]
    theirs = sorted(tuple(r[names.index(c)] for c in columns) for r in result.fetchall())
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == theirs


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, FOLDER).count() > 0
