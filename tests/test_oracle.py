"""Every registered query against its SQL in a second engine."""

from __future__ import annotations

import os

import pytest
from compare import connect, differences
from places import DATA

import __spark_entry__ as entry
from salesaudit.catalogue.oracle import oracle_sql
from salesaudit.catalogue.queries import QUERIES

FOLDER = os.environ.get("ORACLE_DIR", f"{DATA}/sf0.01")
SQL = oracle_sql()


@pytest.fixture(scope="module")
def tables():
    return connect(FOLDER)


def test_every_query_has_its_sql():
    assert sorted(QUERIES) == sorted(SQL)
    assert QUERIES.keys() <= entry.queries().keys() and SQL.items() <= entry.oracle_sql().items()


@pytest.mark.parametrize("name", QUERIES)
def test_matches_sql(spark, tables, name):
    assert differences(QUERIES[name](spark, FOLDER), tables.sql(SQL[name])) == ""


def test_the_comparison_sees_a_difference(spark, tables):
    wrong = SQL["product_type_performance"].replace("'Ticket'", "'Pass'")
    frame = QUERIES["product_type_performance"](spark, FOLDER)
    assert differences(frame, tables.sql(wrong)) != ""


def test_entry_has_rows(spark):
    # three product types, a blank one and none
    assert entry.entry(spark).count() == 5
