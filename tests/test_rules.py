"""Which slices take a row: one table of hand-made rows and the expected slices."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fiscus.operators.aggregate import matching_slices
from fiscus.operators.filters import revenue_accounts
from fiscus.plans.catalogue import CATALOGUE, rule_by_id
from fiscus.schema import NAME, Horizon
from tests.conftest import fact_row, make_fact

CASES = [
    (dict(name="Imposto sobre a Renda"), {"c01"}),
    (dict(name="Imposto sobre a Renda - Multa"), {"c06"}),
    (dict(name="IPVA - Principal"), {"c02"}),
    (dict(name="ipva minúsculo"), {"c05"}),
    (dict(name="ITCMD", month=6), set()),
    (dict(name="ITCMD", month=7), {"c03a"}),
    (dict(name="ITCMD", month=1), {"c03b"}),
    (dict(name="ITCMD", month=2), set()),
    (dict(name="ITCMD - Dívida Ativa", month=7), {"c06"}),
    (dict(name="ICMS - Principal"), {"c04"}),
    (dict(name="ICMS", account="62131020201"), set()),
    (dict(name="ICMS", account="6213102020"), {"c04"}),
    (dict(name="IPVA", account="62131020201"), {"c02"}),
    (dict(name="ICMS e IPVA"), {"c02", "c04"}),
    (dict(name="ITBI"), set()),
    (dict(name="Taxa de Inspeção"), {"c05"}),
    (dict(name=None), set()),
    (dict(name=None, origin="12"), {"c07"}),
    (dict(name="Juro"), {"c06"}),
    (dict(origin="13", name="Remuneração de Depósitos"), {"c08"}),
    (dict(origin="13", name="Aluguéis", year=2020, month=1), {"c09"}),
    (dict(origin="13", name="Aluguéis", year=2020, month=2), set()),
    (dict(origin="13", name="Aluguéis", year=2019, month=1), set()),
    (dict(origin="13", name=None, year=2020, month=1), set()),
    (dict(origin="14"), {"c10"}),
    (dict(origin="15"), {"c11"}),
    (dict(origin="16", name="Contribuição Médica"), {"c12a"}),
    (dict(origin="16", name="Contribuição SUS", month=8), {"c12a", "c12b"}),
    (dict(origin="16", name="SUS", month=7), set()),
    (dict(origin="16", name="SUS", month=1), {"c12b_budget"}),
    (dict(origin="16", name="Outros Serviços"), {"c12c"}),
    (dict(origin="17", name="Cota-Parte do Fundo de Participação dos Estados"), {"c13"}),
    (dict(origin="17", name="Cota-Parte do IPI"), {"c14"}),
    (dict(origin="17", name="FEX"), {"c15"}),
    (dict(origin="17", name="L.C. N. 87/96"), {"c16"}),
    (dict(origin="17", name="FNDE", month=2), {"c17"}),
    (dict(origin="17", name="FNDE", month=1), {"c17_budget"}),
    (dict(origin="17", name="FNDE", month=3), set()),
    (dict(origin="17", name="Salário-Educação"), {"c18"}),
    (dict(origin="17", name="CIDE"), {"c19"}),
    (dict(origin="17", name="FUNDEB"), {"c20"}),
    (dict(origin="17", name="FUNDEB", fund="0128000000"), {"c20", "c22"}),
    (dict(origin="17", name="SUS", fund="0223000000", year=2020, month=1), {"c21"}),
    (dict(origin="17", name="SUS", fund="0223000000", year=2019, month=1), set()),
    (dict(origin="17", name="SUS", fund="9922300000", year=2020, month=1), {"c21", "c23"}),
    (dict(origin="17", name="Convênio", fund="0228000000"), {"c22"}),
    (dict(origin="17", name="Convênio", fund="0912800000"), {"c22", "c23"}),
    (dict(origin="17", name="Outras"), {"c23"}),
    (dict(origin="17", name="Outras", fund=None), set()),
    (dict(origin="17", name="Lei 12.276"), set()),
    (dict(origin="17", name="Lei 12x276"), {"c23"}),
    (dict(origin="19", name="Multas"), {"c24"}),
    (dict(origin="19", name="Restituições de Convênios"), set()),
    (dict(origin="19", name="Recuperação"), set()),
    (dict(origin="19", name="PRODEC"), {"prodec"}),
    (dict(origin="72", month=1), {"c30"}),
    (dict(origin="72", month=2), set()),
    (dict(origin="73", month=9), {"c31"}),
    (dict(origin="76", year=2019, month=2), {"c32"}),
    (dict(origin="76", year=2019, month=6), {"c32"}),
    (dict(origin="76", year=2019, month=7), set()),
    (dict(origin="76", year=2019, month=1), set()),
    (dict(origin="76", year=2020, month=3), set()),
    (dict(origin="76", year=2020, month=1), {"c32_budget"}),
    (dict(origin="79", name="Outras intra"), {"c33"}),
    (dict(origin="79", name="Recuperação intra"), set()),
    (dict(origin="21"), {"capital_loans"}),
    (dict(origin="22", name="Alienação - Poder Executivo"), {"capital_disposals"}),
    (dict(origin="22", name="Alienação - Poder Judiciário"), set()),
    (dict(origin="23"), {"capital_amortisation"}),
    (dict(origin="24"), {"capital_transfers"}),
    (dict(origin="89"), {"capital_other"}),
    (dict(origin="99"), set()),
    (dict(origin="12", account="99521000000"), {"c07"}),
    (dict(origin="12", account="62132999999"), {"c07"}),
    (dict(origin="12", account="62129000000"), set()),
    (dict(origin="12", account="96212100000"), set()),
    (dict(origin="12", account=None), set()),
]


def test_rows_reach_exactly_their_slices(spark):
    rows = [fact_row(**{"unit": str(i), **case}) for i, (case, _) in enumerate(CASES)]
    fact = make_fact(spark, rows)
    found = {
        int(row[0]): set(row[1])
        for row in revenue_accounts(fact)
        .select("cod_unidade_gestora", matching_slices(CATALOGUE, Horizon()))
        .collect()
    }
    for i, (case, expected) in enumerate(CASES):
        assert found.get(i, set()) == expected, case


def test_every_rule_is_matched_by_a_case():
    assert {slice_id for _, slices in CASES for slice_id in slices} == {r.slice_id for r in CATALOGUE}


def test_catalogue_has_forty_slices_with_verbatim_labels():
    assert len(CATALOGUE) == 40 == len({rule.slice_id for rule in CATALOGUE})
    assert rule_by_id("c09").label == " 9.Receita Patrimonial - Não financeiras"
    assert rule_by_id("c10").label == " 10. Receita Agropecuária"
    assert rule_by_id("c13").label.endswith("Estado e DF ")
    assert rule_by_id("c33").label.endswith("outras receitas correntes\n")
    assert rule_by_id("capital_transfers").label == "Transferências de capital "
    not_in_budget_law = {rule.slice_id for rule in CATALOGUE if rule.ldo == "N"}
    assert not_in_budget_law == {
        "c30", "c31", "c32", "c32_budget", "c33", "prodec", "capital_loans", "capital_disposals",
        "capital_amortisation", "capital_transfers", "capital_other",
    }


@pytest.mark.parametrize("word", ["it's", "back\\slash", "100%", "a_b"])
def test_words_are_taken_literally(spark, word):
    from fiscus.functions.predicates import contains_any

    fact = make_fact(spark, [fact_row(name=f"x {word} y"), fact_row(name="x it y backslash 1000 aXb")])
    assert [r[0] for r in fact.filter(contains_any(NAME, [word])).select(F.col(NAME)).collect()] == [
        f"x {word} y"
    ]
