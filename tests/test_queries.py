"""Every registered core query against its SQL, on the smallest tables that fill its budgets."""

import os

import duckdb
import pytest

from corvane.plans import oracle, oracle_files
from corvane.plans.files import COUNTS, FILES
from corvane.plans.queries import QUERIES as CORE

DATA = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER"}
SQL, QUERIES = oracle.sql() | oracle_files.sql(COUNTS), CORE | FILES

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def test_all_queries_are_known():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == {"syntax_valid"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert {d[0]: str(d[1]) for d in found.description} == {c: TYPES[t] for c, t in df.dtypes}
    key = lambda row: tuple((v is None, str(v)) for v in row)
    expected = sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=key)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key) == expected


def test_plans_push_filters_and_prune_columns(spark):
    plan = QUERIES["review_exclusion"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan and "EqualTo(quality,0)" in plan
    assert "Python" not in QUERIES["doc_words"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
