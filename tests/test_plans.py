"""Properties of the physical plans that must hold at any scale."""

from __future__ import annotations

import re

import pytest

from fiscus.operators.aggregate import reduce_fact
from fiscus.plans.catalogue import CATALOGUE, rule_by_id
from fiscus.plans.projection_plan import category_slice, project_revenue
from fiscus.schema import KEYS, Horizon
from fiscus.sources.fact import read_fact_parquet
from testbed.queries import queries
from tests.conftest import SMALL_TABLES, fact_row, make_fact


@pytest.fixture(scope="module")
def stored_fact(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "fact")
    rows = [fact_row(year=year, month=month, collected="1") for year in (2018, 2019, 2020) for month in (1, 8)]
    make_fact(spark, rows).write.partitionBy("num_ano").parquet(path)
    return read_fact_parquet(spark, path)


def plan_of(frame):
    return frame._jdf.queryExecution().explainString(
        frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    )


def test_result_reads_the_fact_once_with_two_shuffles(stored_fact):
    plan = plan_of(project_revenue(stored_fact))
    assert plan.count("FileScan") == 1
    assert len(re.findall(r"\bExchange ", plan)) == 2
    assert plan.count("BroadcastExchange") == 1
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_common_filters_reach_the_scan(stored_fact):
    plan = plan_of(project_revenue(stored_fact))
    assert "StringContains(cod_conta_contabil,521)" in plan
    assert "StringStartsWith(cod_conta_contabil,62121)" in plan
    assert "In(cod_origem" in plan


def test_slice_filters_reach_the_scan_and_prune_years(stored_fact):
    plan = plan_of(category_slice(stored_fact, rule_by_id("c09")))
    assert "EqualTo(cod_origem,13)" in plan
    assert "StringContains(nom_detalhamento,Remuneração)" in plan
    assert "LessThanOrEqual(num_mes,1)" in plan
    assert re.search(r"PartitionFilters: \[.*num_ano.* >= 2020", plan)


def test_slice_reads_only_its_columns(stored_fact):
    plan = plan_of(category_slice(stored_fact, rule_by_id("c03b")))
    schema = re.search(r"ReadSchema: (\S+)", plan).group(1)
    assert "val_receita_orcada" in schema
    assert "val_receita_arrecadada" not in schema


def test_months_collapse_before_the_shuffle(spark):
    """A key that holds most rows leaves the first step as one row per month class."""
    rows = [fact_row(name="ITCMD", month=1 + i % 12, collected="1") for i in range(600)]
    reduced = reduce_fact(make_fact(spark, rows), CATALOGUE, Horizon())
    assert sorted(r.num_mes for r in reduced.select("num_mes").collect()) == [1, 2, 7]
    assert reduced.groupBy(*KEYS).count().count() == 1
    plan = plan_of(reduced)
    assert plan.index("partial_sum") > plan.index("Exchange")


@pytest.mark.parametrize("name", sorted(queries()))
def test_no_query_joins_without_a_key_or_leaves_the_jvm(spark, name):
    if name == "publish_parquet_readback":
        pytest.skip("writes its result; its plan is the one of revenue_projection")
    plan = plan_of(queries()[name](spark, SMALL_TABLES))
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan
    assert plan.count("FileScan") == 1


def test_generated_methods_stay_small_enough_to_be_compiled(spark, stored_fact):
    """The JVM interprets methods above 8,000 bytes of bytecode."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
        text = project_revenue(stored_fact)._jdf.queryExecution().explainString(mode)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(size) for size in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) < 8000


def test_periods_that_no_rule_takes_are_left_at_the_scan(stored_fact):
    plan = plan_of(project_revenue(stored_fact))
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan, re.S).group(1)
    assert "Or(Not(EqualTo(cod_origem,72)),LessThanOrEqual(num_mes,1))" in pushed.replace(" ", "")


def test_rows_outside_all_periods_never_reach_the_first_shuffle(spark):
    rows = [fact_row(origin="72", month=month, collected="1") for month in range(1, 13)]
    reduced = reduce_fact(make_fact(spark, rows), CATALOGUE, Horizon()).collect()
    assert len(reduced) == 1 and reduced[0].num_mes <= 1
