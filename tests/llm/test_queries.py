"""The registered queries against their SQL on the smallest driver tables."""

import os

import duckdb
import pytest

from gazette.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.queries()) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    result = queries.queries()[name](spark, FOLDER)
    sql = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in sql.description]
    columns = sorted(result.columns)
    assert columns == sorted(names)
    got = sorted((tuple(r[c] for c in columns) for r in result.collect()), key=repr)
    assert got == sorted((tuple(row[names.index(c)] for c in columns) for row in sql.fetchall()), key=repr)
