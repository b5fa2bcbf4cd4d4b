"""Every registered query against DuckDB on the same Parquet files."""

from __future__ import annotations

import math
import os
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def cell(value):
    if isinstance(value, datetime):
        return value.isoformat(" ")
    if isinstance(value, date):
        return value.isoformat()
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    assert not isinstance(value, Decimal), "decimals must be cast on both sides"
    return str(value)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    body = sorted(tuple(cell(row[i]) for i in order) for row in rows)
    return sorted(names), body


KINDS = {
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "boolean": "BOOLEAN",
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(name, spark, duck):
    ours = QUERIES[name](spark, FOLDER)
    theirs = duck.execute(ORACLES[name])
    kinds = {column[0]: str(column[1]) for column in theirs.description}
    names, rows = table([c[0] for c in theirs.description], theirs.fetchall())
    got_names, got_rows = table(ours.columns, [tuple(r) for r in ours.collect()])
    assert got_names == names
    assert {n: KINDS[t] for n, t in ours.dtypes} == kinds
    assert len(got_rows) == len(rows)
    assert got_rows == rows
    assert rows, "an empty result checks nothing"


def test_every_query_has_an_oracle():
    assert set(ORACLES) <= set(QUERIES)
