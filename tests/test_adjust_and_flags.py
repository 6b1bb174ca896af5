from __future__ import annotations

import pytest

from fiscus.operators.adjust import consolidate_fund, deflate, derive_codes, relabel_year
from fiscus.operators.flags import (
    RLI_EXCLUDED_ACCOUNTS, flag_audit, flag_rcl, flag_rli,
)
from fiscus.plans.projection_plan import project_revenue
from fiscus.schema import Horizon
from fiscus.sources.parameters import Parameters
from testbed.oracle import RCL_PREFIXES, RLI_PREFIXES
from tests.conftest import fact_row, make_fact


def test_collected_revenue_of_any_year_moves_to_the_first_projected_year(spark):
    cases = [("62121000000", 2015, 2020), ("621", 2021, 2020), ("52111000000", 2019, 2019),
             ("62", 2019, 2019), ("06210000000", 2019, 2019), (None, 2019, 2019)]
    frame = spark.createDataFrame([c[:2] for c in cases], "cod_conta_contabil string, num_ano int")
    found = {r.cod_conta_contabil: r.num_ano for r in relabel_year(frame, Horizon()).collect()}
    assert found == {account: expected for account, _, expected in cases}


def test_seeds_look_at_the_year_before_it_is_relabelled(spark):
    fact = make_fact(spark, [fact_row(collected="100", year=2019), fact_row(collected="50", year=2018)])
    rows = project_revenue(fact).filter("nome_receita_ldo = '4.ICMS'").collect()
    assert {r.num_ano for r in rows} == {2020}
    assert sorted(r.projecao_receita_arrecadada_liquida2020 for r in rows) == [0.0, 100 * 1.0305 * 1.0002]


def test_funds_and_their_codes(spark):
    frame = spark.createDataFrame(
        [("0161000000",), ("0162000000",), ("0162000001",), ("0223000000",), (None,)],
        "cod_fonte_recurso string",
    )
    found = [tuple(r) for r in derive_codes(consolidate_fund(frame)).collect()]
    assert found == [
        ("0100000000", "0100", "00"), ("0100000000", "0100", "00"), ("0162000001", "0162", "62"),
        ("0223000000", "0223", "23"), (None, None, None),
    ]


def test_first_year_deflates_the_budget_and_later_years_the_projection(spark):
    columns = ["receita_orcada_liquida"] + [f"projecao_receita_arrecadada_liquida{y}" for y in range(2020, 2024)]
    frame = spark.createDataFrame([(10.0, 1.0, 20.0, 30.0, 40.0)], ", ".join(f"{c} double" for c in columns))
    row = deflate(frame, Parameters.default(), Horizon()).collect()[0].asDict()
    assert row["projecao2020aValoresDe2019"] == 10.0 / 1.0305
    assert row["projecao2021aValoresDe2019"] == 20.0 / (1.0305 * 1.0357)
    assert row["projecao2022aValoresDe2019"] == 30.0 / (1.0305 * 1.0357 * 1.035)
    assert row["projecao2023aValoresDe2019"] == 40.0 / (1.0305 * 1.0357 * 1.035 * 1.035)


def codes():
    """Each prefix alone, continued, cut short by a digit, and embedded."""
    found = {None, "", "2"}
    for prefix in (*RCL_PREFIXES, *RLI_PREFIXES):
        found |= {prefix, prefix + "99", prefix[:-1], "0" + prefix}
    return sorted(found, key=str)


ACCOUNTS = ["62121000000", "62131010000", "6213101", "621310", "52112010100", "521120101", "52112010", None]


@pytest.fixture(scope="module")
def coded(spark):
    rows = [(code, account) for code in codes() for account in ACCOUNTS]
    return spark.createDataFrame(rows, "cod_detalhamento string, cod_conta_contabil string").cache()


def starts(value, prefixes):
    return value is not None and any(value.startswith(prefix) for prefix in prefixes)


def test_flags_against_brute_force(coded):
    for row in flag_rli(flag_rcl(coded)).collect():
        assert row.rcl == ("S" if starts(row.cod_detalhamento, RCL_PREFIXES) else "")
        excluded = row.cod_conta_contabil is None or starts(row.cod_conta_contabil, RLI_EXCLUDED_ACCOUNTS)
        taken = starts(row.cod_detalhamento, RLI_PREFIXES) and not excluded
        assert row.RLI == ("S" if taken else "")


def test_audit_counts_against_brute_force(coded):
    values = [row.cod_detalhamento for row in coded.collect()]
    expected = {
        (flag, ord_, prefixes[ord_ - 1], sum(starts(value, prefixes[:ord_]) for value in values))
        for flag, prefixes in (("rcl", RCL_PREFIXES), ("RLI", RLI_PREFIXES))
        for ord_ in range(1, len(prefixes) + 1)
    }
    assert {tuple(row) for row in flag_audit(coded).collect()} == expected


def test_audit_lists_prefixes_without_rows(spark):
    nothing = spark.createDataFrame([("999", "1")], "cod_detalhamento string, cod_conta_contabil string")
    rows = flag_audit(nothing).collect()
    assert len(rows) == 48 and {row.matched_rows for row in rows} == {0}


def test_prefix_lists():
    assert (len(RCL_PREFIXES), len(RLI_PREFIXES)) == (31, 17)
