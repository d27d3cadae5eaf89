"""Every registered query against its DuckDB text: names, types, rows and exact values."""

from __future__ import annotations

import math
import re
from collections import Counter
from datetime import date, datetime
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as registry

SF_DIR = "/root/testdata/sf0.01"
SQL = registry.oracle_sql()

DUCKDB_TYPES = {
    "string": "VARCHAR",
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
    "boolean": "BOOLEAN",
}


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    if isinstance(value, (date, datetime)):
        return str(value)
    return value


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(record[i]) for i in order) for record in records)


@pytest.fixture(scope="session")
def duck():
    connection = duckdb.connect()
    for path in sorted(Path(SF_DIR).glob("*.parquet")):
        connection.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return connection


def test_every_query_has_sql():
    own = {name for name in registry.queries() if name != "pipeline" and not re.match(r"op\d+_", name)}
    assert own <= set(SQL) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    expected = duck.sql(SQL[name])
    actual = registry.queries()[name](spark, SF_DIR)
    assert sorted((c, DUCKDB_TYPES[t]) for c, t in actual.dtypes) == sorted(
        zip(expected.columns, map(str, expected.types))
    )
    assert rows(actual.columns, actual.collect()) == rows(expected.columns, expected.fetchall())
