"""Every core query with SQL agrees with DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import mnemospark.plans.queries as plans

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 5) + 0.0
    if hasattr(x, "isoformat"):
        return x.isoformat()[:26].replace("+00:00", "")
    return float(x) if type(x).__name__ == "Decimal" else x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_agrees_with_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    ours = sorted(repr([cell(r[c]) for c in columns]) for r in df.collect())
    result = duck.execute(plans.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    theirs = sorted(repr([cell(r[names.index(c)]) for c in columns]) for r in result.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, FOLDER).count() > 0


def test_nothing_in_the_core_imports_llm():
    root = os.path.dirname(os.path.dirname(os.path.abspath(plans.__file__)))
    for path in glob.glob(f"{root}/**/*.py", recursive=True):
        if f"{os.sep}llm{os.sep}" not in path:
            text = open(path).read()
            assert "from .llm" not in text and "from ..llm" not in text and "mnemospark.llm" not in text, path
