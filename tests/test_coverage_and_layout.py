"""Overlaps and gaps of the slices, the bucketed layout, scenarios in one scan."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from fiscus.operators.aggregate import net_sum
from fiscus.operators.coverage import reconciliation, slice_coverage
from fiscus.operators.filters import revenue_accounts
from fiscus.plans.catalogue import CATALOGUE, rule_by_id
from fiscus.plans.projection_plan import project_revenue
from fiscus.plans.scenarios import SCENARIO, project_scenarios
from fiscus.schema import BUDGETED, COLLECTED, COLLECTED_DEDUCTION, KEYS, ORIGIN, YEAR, Horizon
from fiscus.sinks import layout
from fiscus.sinks.layout import write_fact_table
from fiscus.sources.parameters import Parameters
from testbed.lineitem_fact import fact_from_lineitem
from testbed.parameter_sets import REVISED
from tests.conftest import SMALL_TABLES, fact_row, make_fact


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_sets_of_slices_hold_every_entry_once(spark):
    rules = [rule_by_id(i) for i in ("c04", "c06", "c21", "c22", "c23")]
    fact = make_fact(spark, [
        fact_row(name="ICMS", collected="10", deduction="1"), fact_row(name="ICMS - Multa", collected="5"),
        fact_row(origin="17", name="Convênio 12", fund="0128000000", collected="7"),
        fact_row(origin="17", name="Convênio 12", fund="0912800000", collected="2"), fact_row(origin="99", name=None, collected="3"),
        fact_row(account="99", collected="100"),
    ])
    found = {r.slices: (r.times, r.entries, float(r.receita_arrecadada_liquida)) for r in slice_coverage(fact, rules, Horizon()).collect()}
    assert found == {"c04": (1, 1, 9.0), "c06": (1, 1, 5.0), "c22": (1, 1, 7.0), "c22+c23": (2, 1, 2.0), "": (0, 1, 3.0)}
    lines = {r.line: (r.entries, r.receita_arrecadada_liquida) for r in reconciliation(slice_coverage(fact, rules, Horizon())).collect()}
    assert lines == {"accounts": (5, 26.0), "slices": (5, 25.0), "repeated": (1, 2.0), "uncovered": (1, 3.0), "difference": (0, 0.0)}


def test_more_rules_than_one_bitmap_word(spark):
    rules = [replace(rule_by_id("c10"), slice_id=f"r{n}", origin="14" if n % 50 == 0 else "15") for n in range(130)]
    fact = make_fact(spark, [fact_row(origin="14", collected="1"), fact_row(origin="15"), fact_row(origin="13")])
    found = {r.slices: r.times for r in slice_coverage(fact, rules, Horizon()).collect()}
    assert found["r0+r50+r100"] == 3 and found[""] == 0 and sorted(found.values()) == [0, 3, 127]


def test_the_bucketed_table_is_grouped_without_an_exchange(spark, tmp_path):
    fact = fact_from_lineitem(spark, SMALL_TABLES)
    table = write_fact_table(fact, "bucketed_fact", 4, str(tmp_path / "fact"))
    grouped = [
        revenue_accounts(f).groupBy(*KEYS).agg(net_sum(COLLECTED, COLLECTED_DEDUCTION).alias("x"), F.sum(BUDGETED).alias("y"))
        for f in (table, fact)
    ]
    assert "Exchange" not in plan_of(grouped[0]) and "Exchange" in plan_of(grouped[1])
    assert sorted(map(repr, grouped[0].collect())) == sorted(map(repr, grouped[1].collect()))
    year = plan_of(table.filter((F.col(YEAR) == 2019) & (F.col(ORIGIN) == "17")))
    assert "PartitionFilters: [isnotnull(num_ano" in year and "EqualTo(cod_origem,17)" in year
    spark.sql("DROP TABLE bucketed_fact")


def test_scenarios_equal_single_runs_from_one_scan(spark):
    fact = fact_from_lineitem(spark, SMALL_TABLES)
    sets = {"a": Parameters.default(), "b": REVISED, "c": Parameters.default().replace({("IPCA", 2022): 1.09})}
    together = project_scenarios(fact, sets)
    assert plan_of(together).count("FileScan") == 1
    rows = together.collect()
    for name, given in sets.items():
        own = sorted(repr(tuple(r)[1:]) for r in rows if r[SCENARIO] == name)
        assert own == sorted(repr(tuple(r)) for r in project_revenue(fact, given).collect())
    assert len(CATALOGUE) == 40


def test_a_large_key_of_the_bucketed_table_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(layout, "BYTES_OF_A_TASK", "20k")
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    amount = (F.rand(3) * 1000).cast("decimal(20,2)")
    rows = spark.range(0, 16_000, 1, 8).join(F.broadcast(make_fact(spark, [fact_row()])))
    fact = rows.withColumn(COLLECTED, amount).drop("id").localCheckpoint()
    table = write_fact_table(fact, "one_key", 4, str(tmp_path / "fact"))
    assert len(table.inputFiles()) > 1  # one task sorted all rows of the key before
    found = table.groupBy(*KEYS).agg(F.sum(COLLECTED), F.count("*"))
    assert "Exchange" not in plan_of(found)
    assert found.collect() == fact.groupBy(*KEYS).agg(F.sum(COLLECTED), F.count("*")).collect()
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == before
    assert layout.buckets_for(600_000) == 8 and layout.buckets_for(216_000_000) == 108
    spark.sql("DROP TABLE one_key")
