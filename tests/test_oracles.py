"""Every query with an SQL equivalent gives the same rows as that SQL."""

from __future__ import annotations

import math

import duckdb
import pytest
from conftest import SF_DIR

import __spark_entry__ as contract
from cashtide.plans.catalog import QUERIES
from oracles.sql import oracle_sql

TABLES = "nation customer part orders events".split()
ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def rows_of(frame):
    def cell(value):
        if value is None or (isinstance(value, float) and math.isnan(value)):
            return "NULL"
        return repr(value.item() if hasattr(value, "item") else value)

    ordered = frame[sorted(frame.columns)]
    return sorted(tuple(cell(v) for v in row) for row in ordered.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    ours = QUERIES[name](spark, SF_DIR).toPandas()
    theirs = duck.execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    done = QUERIES[name](spark, SF_DIR)
    assert done.columns
    assert done.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0
