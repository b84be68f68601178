"""Every registered query against its SQL, on the smallest tables (MEASUREKIT_SF_DIR chooses others)."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from measurekit.plans.queries import QUERIES as CORE
from oracle.sql import oracle_sql
from tests.oracle_compare import connect, spark_rows, sql_rows

SF_DIR = os.environ.get("MEASUREKIT_SF_DIR", "/root/testdata/sf0.001")
SQL = oracle_sql()
QUERIES = {name: query for name, query in entry.queries().items() if name in CORE}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert spark_rows(QUERIES[name](spark, SF_DIR)) == sql_rows(con, SQL[name])


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 11
