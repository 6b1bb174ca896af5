"""Seeds, chains and measures against numbers worked out in Python."""

from __future__ import annotations

import pytest

from fiscus.plans.catalogue import CATALOGUE, rule_by_id
from fiscus.plans.projection_plan import category_slice, project_revenue, stacked_slices
from fiscus.schema import Horizon
from fiscus.sources.parameters import Parameters
from tests.conftest import fact_row, make_fact


def only_row(frame):
    rows = frame.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def projections(row):
    return [row[f"projecao_receita_arrecadada_liquida{year}"] for year in range(2020, 2024)]


def both_ways(fact, slice_id):
    """The slice alone and in the single pass; both must agree."""
    rule = rule_by_id(slice_id)
    alone = only_row(category_slice(fact, rule))
    assert alone == only_row(stacked_slices(fact, rules=[rule]))
    return alone


def test_icms_multiplies_from_left_to_right(spark):
    fact = make_fact(spark, [fact_row(collected="1000.10"), fact_row(collected="0.20", deduction="100.05")])
    row = both_ways(fact, "c04")
    net = 900.25
    first = net * 1.0305 * 1.0002 * 1.0
    second = first * 1.025 * 1.0357
    third = second * 1.025 * 1.035
    assert row["receita_arrecadada_liquida"] == net
    assert projections(row) == [first, second, third, third * 1.025 * 1.035]


def test_rows_outside_the_seed_year_project_zero(spark):
    fact = make_fact(spark, [fact_row(collected="5", year=2018)])
    assert projections(both_ways(fact, "c04")) == [0.0, 0.0, 0.0, 0.0]


def test_unknown_amounts_stay_unknown(spark):
    fact = make_fact(spark, [fact_row(collected=None, deduction="3", budgeted="7", budget_deduction=None)])
    row = both_ways(fact, "c04")
    assert row["receita_arrecadada_liquida"] is None
    assert row["receita_orcada_liquida"] is None
    assert projections(row) == [None] * 4


def test_unknown_amounts_are_skipped_in_sums(spark):
    fact = make_fact(spark, [fact_row(collected=None, month=1), fact_row(collected="2", month=2)])
    assert both_ways(fact, "c04")["receita_arrecadada_liquida"] == 2.0


def test_largest_collection_instead_of_sum(spark):
    rows = [
        fact_row(origin="17", name="87/96", collected="10", deduction="1", budgeted="4", month=1),
        fact_row(origin="17", name="87/96", collected="7", deduction="3", budgeted="5", month=9),
    ]
    row = both_ways(make_fact(spark, rows), "c16")
    assert row["receita_arrecadada_liquida"] == 7.0
    assert row["receita_orcada_liquida"] == 9.0
    assert projections(row) == [0.0] * 4


def test_second_half_year_doubles_and_budget_is_zero(spark):
    rows = [
        fact_row(name="ITCMD", collected="10", budgeted="99", month=7),
        fact_row(name="ITCMD", collected="5", budgeted="99", month=12),
        fact_row(name="ITCMD", collected="1000", month=6),
    ]
    row = both_ways(make_fact(spark, rows), "c03a")
    assert (row["receita_arrecadada_liquida"], row["receita_orcada_liquida"]) == (15.0, 0.0)
    assert projections(row)[:2] == [30.0, 30.0 * 1.0357]


def test_five_months_become_twelve(spark):
    rows = [fact_row(origin="16", name="SUS", collected="10.01", month=month) for month in (7, 8, 9, 12)]
    row = both_ways(make_fact(spark, rows), "c12b")
    assert row["receita_arrecadada_liquida"] == 12 * (30.03 / 5)
    assert projections(row)[0] == row["receita_arrecadada_liquida"]


def test_five_months_become_a_monthly_mean(spark):
    rows = [fact_row(origin="76", collected="10.01", month=month) for month in range(1, 13)]
    row = both_ways(make_fact(spark, rows), "c32")
    mean = 50.05 / 5
    assert row["receita_arrecadada_liquida"] == mean
    assert projections(row)[0] == mean * 11.14 * 1.05


@pytest.mark.parametrize(
    "slice_id, row, first",
    [
        ("c07", dict(origin="12"), 100.0 * (1.05 - 0.02)),
        ("c02", dict(name="IPVA"), 100.0 * 0.97),
        ("c09", dict(origin="13", name="x", year=2020), 100.0 * 1.0305),
        ("c17", dict(origin="17", name="FNDE", year=2020, month=2), 1000.0),
        ("c21", dict(origin="17", fund="0223000000", year=2020), 12 * 100.0 * 1.0305),
        ("c30", dict(origin="72", year=2020), 1300.0),
        ("c15", dict(origin="17", name="FEX"), 0.0),
        ("prodec", dict(origin="19", name="PRODEC"), 0.0),
        ("capital_loans", dict(origin="21"), 0.0),
    ],
)
def test_first_projected_year(spark, slice_id, row, first):
    fact = make_fact(spark, [fact_row(collected="100", **row)])
    assert projections(both_ways(fact, slice_id))[0] == first


def test_interest_rate_ratio_and_fleet_factor_in_the_chain(spark):
    income = both_ways(make_fact(spark, [fact_row(origin="13", name="Remuneração", collected="100")]), "c08")
    first = 100.0 * 1.0305
    assert projections(income)[1] == first * 1.0357 * (0.0525 / 0.0375)
    fleet = both_ways(make_fact(spark, [fact_row(name="IPVA", collected="100")]), "c02")
    values = projections(fleet)
    assert values[1] == 97.0 * (1.0357 * 1.025 * 0.97)
    assert values[3] == values[2] * (1.035 * 1.025 * 0.97)


def test_actual_and_budget_rows_with_equal_keys_stay_apart(spark):
    rows = [
        fact_row(origin="17", name="FNDE", month=1, collected="5", budgeted="50"),
        fact_row(origin="17", name="FNDE", month=2, collected="7", budgeted="70"),
    ]
    found = stacked_slices(make_fact(spark, rows)).collect()
    assert sorted((r.receita_arrecadada_liquida, r.receita_orcada_liquida) for r in found) == [
        (0.0, 50.0), (7.0, 70.0),
    ]


def test_horizon_and_parameters_are_arguments(spark):
    """The same projection one year later, with every index moved along."""
    later = Parameters(
        {(name, year + 1): value for (name, year), value in Parameters.default().values.items()}
        | {("ANFAVEA", 2022): 1.1, ("ANFAVEA", 2023): 1.2, ("ANFAVEA", 2024): 1.3}
    )
    horizon = Horizon(2020, 2024)
    fact = make_fact(spark, [fact_row(collected="100", year=2020, account="52111000000")])
    row = only_row(category_slice(fact, rule_by_id("c04"), later, horizon))
    assert row["projecao_receita_arrecadada_liquida2021"] == 100 * 1.0305 * 1.0002
    result = project_revenue(fact, later, horizon)
    assert result.columns[-1] == "projecao2024aValoresDe2020"
    assert result.count() == 5


def test_parameter_change_reaches_the_result(spark):
    changed = Parameters.default().replace({("IPCA", 2020): 2.0, ("PIB", 2020): 1.0})
    fact = make_fact(spark, [fact_row(collected="100")])
    row = only_row(category_slice(fact, rule_by_id("c04"), changed))
    assert projections(row)[0] == 200.0


def test_exact_sums_of_many_cents(spark):
    """Ten thousand times one cent is one hundred, whatever the order of addition."""
    rows = [fact_row(collected="0.01", month=1 + i % 12) for i in range(10_000)]
    assert both_ways(make_fact(spark, rows), "c04")["receita_arrecadada_liquida"] == 100.0


def test_all_rules_resolve_over_the_default_horizon(spark):
    assert stacked_slices(make_fact(spark, [fact_row()]), rules=CATALOGUE).count() == 1
