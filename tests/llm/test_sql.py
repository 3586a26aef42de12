import os

import duckdb
import pytest

from corvane.llm import queries as Q

DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet')")
    df = Q.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    found = con.execute(Q.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    types = {"bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}
    assert {d[0]: str(d[1]) for d in found.description} == {c: types[t] for c, t in df.dtypes}
    expected = sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == expected
