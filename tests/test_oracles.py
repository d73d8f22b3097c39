"""Every query against its SQL, on the smallest generated tables."""

import math
import os
from glob import glob

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not glob(f"{DATA}/*.parquet"), reason="no generated tables")

DUCK_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob(f"{DATA}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def _rows(rows):
    return sorted((tuple(_plain(v) for v in row) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = queries()[name](spark, DATA)
    columns = sorted(df.columns)
    relation = duck.sql(oracle_sql()[name])
    assert sorted(relation.columns) == columns
    types = dict(zip(relation.columns, map(str, relation.types)))
    assert {c: DUCK_TYPES[t] for c, t in df.dtypes} == types
    order = [relation.columns.index(c) for c in columns]
    expected = _rows([row[i] for i in order] for row in relation.fetchall())
    assert _rows(df.select(*columns).collect()) == expected


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0
