"""Every registered query gives exactly what its SQL twin gives."""

from __future__ import annotations

import os
from dataclasses import replace

import duckdb
import pytest

import __spark_entry__ as entry_point
from fiscus.plans.catalogue import CATALOGUE
from fiscus.plans.projection_plan import project_revenue
from testbed import oracle, queries
from tests.conftest import SMALL_TABLES

QUERIES = queries.queries()
STATEMENTS = oracle.statements()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(SMALL_TABLES):
        name = file.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SMALL_TABLES}/{file}')")
    yield con
    con.close()


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([row[i] for i in order]) for row in rows)


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(STATEMENTS)
    assert set(QUERIES) <= set(entry_point.queries()) and set(STATEMENTS) <= set(entry_point.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_statement(spark, duck, name):
    frame = QUERIES[name](spark, SMALL_TABLES)
    expected = duck.execute(STATEMENTS[name])
    expected_columns = [column[0] for column in expected.description]
    assert sorted(frame.columns) == sorted(expected_columns)
    assert sorted_rows(frame.columns, frame.collect()) == sorted_rows(expected_columns, expected.fetchall())


def test_entry_has_the_published_columns(spark):
    frame = entry_point.entry(spark)
    assert len(frame.columns) == 24
    assert frame.count() > 0


def rows_with(spark, parameters=queries.REVISED, rules=CATALOGUE):
    frame = project_revenue(queries.fact_from_lineitem(spark, SMALL_TABLES), parameters, rules=rules)
    return sorted_rows(frame.columns, frame.collect())


def without_effort(rule):
    seed = tuple(factor for factor in rule.seed if factor != "EF")
    return replace(rule, seed=seed) if rule.slice_id == "c04" else rule


def test_the_revised_check_notices_a_lost_factor_and_a_neighbours_year(spark, duck):
    expected = duck.execute(STATEMENTS["revenue_projection_revised_parameters"])
    columns = [column[0] for column in expected.description]
    right = sorted_rows(columns, expected.fetchall())
    assert rows_with(spark) == right
    assert rows_with(spark, rules=[without_effort(rule) if rule.seed else rule for rule in CATALOGUE]) != right
    revised = queries.REVISED
    swapped = {("IPCA", 2022): revised.value("IPCA", 2023), ("IPCA", 2023): revised.value("IPCA", 2022)}
    assert rows_with(spark, revised.replace(swapped)) != right
