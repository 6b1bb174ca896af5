"""The single pass equals one query per slice, and both equal SQL, on rough data."""

from __future__ import annotations

import random
from functools import reduce

import duckdb
import pytest
from pyspark.sql import DataFrame

from fiscus.operators.flags import flag_audit
from fiscus.plans.catalogue import CATALOGUE
from fiscus.plans.projection_plan import (
    category_slice, project_revenue, stacked_slices, stacked_with_manual_rows,
)
from fiscus.schema import FACT_SCHEMA
from testbed import oracle
from testbed.lineitem_fact import fact_sql
from tests.conftest import fact_row, make_fact
from tests.test_oracle import sorted_rows

NAMES = [
    None, "", "ICMS - Principal", "ICMS - Multa", "ITCMD", "IPVA e ICMS", "Imposto sobre a Renda", "ITBI",
    "Taxa - Juro", "Dívida Ativa ITCMD", "Remuneração", "Aluguéis", "Contribuição SUS", "SUS", "Contribuição",
    "Cota-Parte do Fundo de Participação", "Cota-Parte do IPI", "FEX", "87/96", "FNDE", "Salário-Educação",
    "CIDE", "FUNDEB", "12.276", "PRODEC", "Recuperação", "Restituições de Convênios", "Poder Executivo",
]
ORIGINS = ["11", "12", "13", "14", "15", "16", "17", "17", "19", "21", "22", "23", "24", "72", "73", "76",
           "79", "89", "99", None]
ACCOUNTS = ["52111000000", "52112010100", "62121000000", "62131010000", "62131020201", "62132000000",
            "62129000000", "99521000000", None]
FUNDS = ["0100000000", "0161000000", "0162000000", "0223000000", "0128000000", "0912800000", "0228000000",
         "7722300000", None]
NATURES = ["1118021100", "1118012100", "1113031100", "17181", "1718061100", "22200012", "19", "2119001100", None]


def rough_rows(seed, count):
    """Random rows with a hot group: a third of all rows share one key."""
    rng = random.Random(seed)

    def money():
        return rng.choice([None, "0", f"{rng.randint(-10**9, 10**12)}e-2", f"{rng.randint(0, 10**15)}e-2"])

    rows = []
    for i in range(count):
        amounts = dict(collected=money(), deduction=money(), budgeted=money(), budget_deduction=money())
        month = rng.choice([None, 0, *range(1, 13), 13])
        if i % 3 == 0:
            rows.append(fact_row(name="ITCMD", month=month, **amounts))
        else:
            rows.append(
                fact_row(
                    origin=rng.choice(ORIGINS), name=rng.choice(NAMES), account=rng.choice(ACCOUNTS),
                    fund=rng.choice(FUNDS), nature=rng.choice(NATURES), unit=rng.choice(["1", "2", None]),
                    year=rng.choice([2017, 2019, 2020, 2021, None]), month=month, **amounts,
                )
            )
    return rows


@pytest.fixture(scope="module", params=[1, 2])
def rough_fact(request, spark):
    return make_fact(spark, rough_rows(request.param, 3000)).cache()


@pytest.fixture()
def duck(rough_fact):
    con = duckdb.connect()
    con.register("fat_arrow", rough_fact.toArrow())
    con.execute("CREATE TABLE fat AS SELECT * FROM fat_arrow")
    yield con
    con.close()


def run(con, statement):
    """The statement over the rough fact instead of the one derived from line items."""
    result = con.execute(statement.replace(fact_sql() + ",", ""))
    columns = [column[0] for column in result.description]
    return sorted_rows(columns, result.fetchall())


def rows_of(frame):
    return sorted_rows(frame.columns, frame.collect())


def test_single_pass_equals_one_query_per_slice(rough_fact):
    one_by_one = reduce(DataFrame.unionByName, [category_slice(rough_fact, rule) for rule in CATALOGUE])
    assert rows_of(stacked_slices(rough_fact)) == rows_of(one_by_one)


def test_single_pass_equals_sql(rough_fact, duck):
    assert rows_of(stacked_slices(rough_fact)) == run(duck, oracle.with_fact(oracle.all_slices()))


def test_result_equals_sql(rough_fact, duck):
    assert rows_of(project_revenue(rough_fact)) == run(duck, oracle.consolidated())


def test_audit_equals_sql(rough_fact, duck):
    assert rows_of(flag_audit(stacked_with_manual_rows(rough_fact))) == run(duck, oracle.audit())


def test_any_subset_of_rules_works_alone(rough_fact):
    for rules in (CATALOGUE[5:6], CATALOGUE[2:4], CATALOGUE[-3:]):
        alone = reduce(DataFrame.unionByName, [category_slice(rough_fact, rule) for rule in rules])
        assert rows_of(stacked_slices(rough_fact, rules=rules)) == rows_of(alone)


def test_empty_fact_leaves_the_manual_rows(spark):
    empty = spark.createDataFrame([], FACT_SCHEMA)
    assert stacked_slices(empty).count() == 0
    assert project_revenue(empty).count() == 4


@pytest.mark.parametrize(
    "settings",
    [
        {"spark.sql.adaptive.enabled": "false"},
        {"spark.sql.shuffle.partitions": "1"},
        {"spark.sql.shuffle.partitions": "37", "spark.sql.adaptive.coalescePartitions.enabled": "false"},
        {"spark.sql.autoBroadcastJoinThreshold": "-1"},
        {"spark.sql.ansi.enabled": "false"},
        {"spark.sql.codegen.wholeStage": "false"},
    ],
    ids=lambda settings: " ".join(key.removeprefix("spark.sql.") for key in settings),
)
def test_result_does_not_depend_on_how_spark_runs_it(spark, rough_fact, settings):
    expected = rows_of(project_revenue(rough_fact))
    previous = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        assert rows_of(project_revenue(rough_fact.repartition(13))) == expected
    finally:
        for key, value in previous.items():
            spark.conf.set(key, value)
