"""Every registered query against DuckDB on the same tables."""

import os

import duckdb
import pytest

import __spark_entry__ as driver
from sluice import checks

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
TABLES = [name[:-8] for name in sorted(os.listdir(SF_DIR)) if name.endswith(".parquet")]

# Spark type -> the DuckDB types that hold the same values
TYPES = {"bigint": {"BIGINT"}, "int": {"INTEGER"}, "string": {"VARCHAR"}, "double": {"DOUBLE"},
         "boolean": {"BOOLEAN"}, "timestamp_ntz": {"TIMESTAMP"}, "timestamp": {"TIMESTAMP"}}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", checks.QUERIES)
def test_query_equals_oracle(spark, duck, name):
    got = driver.queries()[name](spark, SF_DIR)
    want = duck.sql(driver.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    types = dict(zip(want.columns, (str(t) for t in want.types)))
    for field in got.schema.fields:
        assert types[field.name] in TYPES[field.dataType.simpleString()], field.name
    ours = sorted((tuple(row[c] for c in columns) for row in got.collect()), key=repr)
    order = [want.columns.index(c) for c in columns]
    theirs = sorted((tuple(row[i] for i in order) for row in want.fetchall()), key=repr)
    assert len(ours) == len(theirs)
    assert ours == theirs
    assert ours, "an empty result checks nothing"


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_every_query_has_an_oracle():
    assert set(checks.QUERIES) == set(checks.SQL)
    assert set(checks.QUERIES) <= set(driver.queries()) and set(checks.SQL) <= set(driver.oracle_sql())
