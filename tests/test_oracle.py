"""Every registered query against its SQL on the smallest driver tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from gazette.checks import oracle, queries

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def ordered(rows, names, columns):
    places = [names.index(c) for c in columns]
    cell = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(cell(row[p]) for p in places) for row in rows), key=repr)


def test_every_query_has_sql():
    assert set(queries.queries()) == set(oracle.oracle_sql())
    assert set(queries.queries()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_equals_sql(spark, duck, name):
    result = queries.queries()[name](spark, FOLDER)
    sql = duck.execute(oracle.oracle_sql()[name])
    names = [c[0] for c in sql.description]
    kinds = {c[0]: str(c[1]) for c in sql.description}
    columns = sorted(result.columns)
    assert columns == sorted(names)
    assert {f.name: TYPES[f.dataType.simpleString()] for f in result.schema.fields} == kinds
    got = ordered([tuple(r) for r in result.collect()], result.columns, columns)
    want = ordered(sql.fetchall(), names, columns)
    assert len(got) > 0 and got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
