"""The 40 category slices.

Everything here is a fixed value: labels, memos, search words, windows,
seeds and growth factors of each category, in category order. Leading and
trailing blanks and the line feed inside a label belong to the value.
"""

from __future__ import annotations

from fiscus.plans.rule import MAX, NONE, Rule

PENALTIES = ("Juro", "Multa", "Dívida Ativa")
FIRST_MONTH = (None, 1)
AFTER_BASE_YEAR = (1, None)
UP_TO_BASE_YEAR = (None, 0)

CATALOGUE: tuple[Rule, ...] = (
    # Taxes.
    Rule(
        "c01", "1.IRRF", "Crescimento vegetativo da folha de salários", "S", "11",
        name_any=("Imposto sobre a Renda",), name_none=PENALTIES,
        seed=("CVFS",), growth=("CVFS",),
    ),
    Rule(
        "c02", "2.IPVA", "Dados da ANFAVEA. Para 2021-2023 PIB+IPCA+3%desvalorização", "S", "11",
        name_any=("IPVA",), name_none=PENALTIES,
        seed=("ANFAVEA",), growth=("ANFAVEA",),
    ),
    Rule(
        "c03a", "3.ITCMD", "2º Semestre de 2019 x 2. Para 2021-2023 utilizado IPCA", "S", "11",
        name_any=("ITCMD",), name_none=PENALTIES, months=(7, None), budget=NONE,
        seed=(2.0,), growth=("IPCA",),
    ),
    Rule(
        "c03b", "3.ITCMD", "2º Semestre de 2019 x 2. Para 2021-2023 utilizado IPCA", "S", "11",
        name_any=("ITCMD",), name_none=PENALTIES, months=FIRST_MONTH, collected=NONE,
        seed=(2.0,), growth=("IPCA",),
    ),
    Rule(
        "c04", "4.ICMS",
        "Execução2019+PIB+IPCA+EF. Para 2021-2023 utilizado PIB+IPCA. EF igualado a zero.", "S", "11",
        name_any=("ICMS",), name_none=PENALTIES, account_none=("62131020201",),
        seed=("IPCA", "PIB", "EF"), growth=("PIB", "IPCA"),
    ),
    Rule(
        "c05", "5.Taxas", "Receita executada de 2019+IPCA+PIB", "S", "11",
        name_none=("ITBI", "ITCMD", "IPVA", "ICMS", "Imposto sobre a Renda", *PENALTIES),
        seed=("IPCA", "PIB"), growth=("IPCA", "PIB"),
    ),
    Rule(
        "c06", "6.Outras receitas tributárias",
        "Receita executada de 2019+IPCA+PIB+Esforço Fiscal. Para 2021-2023 IPCA+PIB. EF igualado a zero",
        "S", "11",
        name_any=PENALTIES,
        seed=("IPCA", "EF", "PIB"), growth=("IPCA", "PIB"),
    ),
    # Contributions and own revenues.
    Rule(
        "c07", "7.Contribuições",
        "Receita executada de 2019+CVFS-2% (A receita de contribuições tem crescido a uma taxa mais "
        "baixa que CVFS. Para 2021-2023 CVFS",
        "S", "12",
        seed=(("CVFS", -0.02),), growth=("CVFS",),
    ),
    Rule(
        "c08", "8.Receita Patrimonial - Rendimento de aplicações financeiras",
        "Receita executada de 2019+IPCA+Aumento da SELIC. Para 2021-2023 IPCA+SELIC.", "S", "13",
        name_any=("Remuneração",),
        seed=("IPCA",), growth=("IPCA", "SELIC_RATIO"),
    ),
    Rule(
        "c09", " 9.Receita Patrimonial - Não financeiras",
        "Início de 2020 x 12. Para 2021-2023 IPCA.", "S", "13",
        name_none=("Remuneração",), months=FIRST_MONTH, years=AFTER_BASE_YEAR, seed_year=1,
        seed=("IPCA",), growth=("IPCA",),
    ),
    Rule(
        "c10", " 10. Receita Agropecuária",
        "Receita executada de 2019+PIB+IPCA. Para 2021-2023 PIB+IPCA.", "S", "14",
        seed=("IPCA", "PIB"), growth=("IPCA", "PIB"),
    ),
    Rule(
        "c11", "11. Receita Industrial",
        "Receita executada de 2019+PIB+IPCA. Para 2021-2023 PIB+IPCA", "S", "15",
        seed=("IPCA", "PIB"), growth=("IPCA", "PIB"),
    ),
    Rule(
        "c12a", "12. Receita de Serviços", "Para contribuições: CVFS. Para os demais PIB+IPCA", "S", "16",
        name_any=("Contribuição",),
        seed=("CVFS",), growth=("CVFS",),
    ),
    Rule(
        "c12b", "12. Receita de Serviços", "Para contribuições: CVFS. Para os demais PIB+IPCA", "S", "16",
        name_any=("SUS",), months=(8, None), collected_months=5, collected_times=12,
        seed=(), growth=("IPCA", "PIB"),
    ),
    Rule(
        "c12b_budget", "12. Receita de Serviços", "Para contribuições: CVFS. Para os demais PIB+IPCA",
        "S", "16",
        name_any=("SUS",), months=FIRST_MONTH, collected=NONE,
        seed=(), growth=("IPCA", "PIB"),
    ),
    Rule(
        "c12c", "12. Receita de Serviços", "Para contribuições: CVFS. Para os demais PIB+IPCA", "S", "16",
        name_none=("SUS", "Contribuição"),
        seed=("IPCA", "PIB"), growth=("IPCA", "PIB"),
    ),
    # Current transfers.
    Rule(
        "c13", "13. Transferências Correntes - Cota-Parte do Fundo Participação Estado e DF ",
        "Receita de 2019 corrigida por PIB+IPCA. Para 2021-2023 PIB+IPCA", "S", "17",
        name_any=("Cota-Parte do Fundo de Participação",),
        seed=("IPCA", "PIB"), growth=("IPCA", "PIB"),
    ),
    Rule(
        "c14", "14. Transferências Correntes - Cota-Parte do IPI",
        "Receita executada de 2019+PIB+IPCA. Para 2021-2023 PIB+IPCA", "S", "17",
        name_any=("IPI",),
        seed=("IPCA", "PIB"), growth=("IPCA", "PIB"),
    ),
    Rule(
        "c15",
        "15. Transferências Correntes - Outras Transferências da União - FEX (Aux. Fom.Export) Tesouro",
        "Legislação Federal - União interrompeu o envio da FEX", "S", "17",
        name_any=("FEX",),
        seed=None, growth=None,
    ),
    Rule(
        "c16",
        "16. Transferências Correntes - Transf. Financeiras do ICMS - Desoneração - L.C. N. 87/96",
        "Legislação Federal", "S", "17",
        name_any=("87/96",), collected=MAX,
        seed=(0.0,), growth=("IPCA", "PIB", 0.0),
    ),
    Rule(
        "c17",
        "17. Transferências Correntes - Outras Transferências Dir. Fundo Nacional do Desenv. da "
        "Educação - FNDE",
        "Fevereiro de 2020 vezes 10 apenas para a parte de alimentação (PNAE). A de obras foi zerada "
        "por falta de visibilidade na receita.",
        "S", "17",
        name_any=("FNDE",), months=(2, 2), seed_year=1,
        seed=(10.0,), growth=("IPCA",),
    ),
    Rule(
        "c17_budget",
        "17. Transferências Correntes - Outras Transferências Dir. Fundo Nacional do Desenv. da "
        "Educação - FNDE",
        "Fevereiro de 2020 vezes 10 apenas para a parte de alimentação (PNAE). A de obras foi zerada "
        "por falta de visibilidade na receita.",
        "S", "17",
        name_any=("FNDE",), months=FIRST_MONTH, collected=NONE, seed_year=1,
        seed=(10.0,), growth=("IPCA",),
    ),
    Rule(
        "c18", "18. Transferências Correntes - Transferências do Salário-Educação",
        "receita de 2019 + IPCA. Para 2021-2023 IPCA", "S", "17",
        name_any=("Salário-Educação",),
        seed=("IPCA", "COVID_EMPREGO"), growth=("IPCA", "COVID_EMPREGO"),
    ),
    Rule(
        "c19",
        "19. Transferências Correntes - Cota-Parte CIDE - Contrib. Intervenção no Domínio Econômico",
        "Receita de 2019 corrigido pelo IPCA + PIB. Para 2021-2023 PIB+IPCA", "S", "17",
        name_any=("CIDE",),
        seed=("IPCA", "PIB"), growth=("IPCA", "PIB"),
    ),
    Rule(
        "c20", "20. Transferências Correntes - Transferências de Recursos do FUNDEB",
        "Receita de 2019+IPCA+PIB+EF+ previsão de que o coeficiente município/estado será estável nos "
        "próximos ano. Para 2021-2023 PIB+IPCA",
        "S", "17",
        name_any=("FUNDEB",),
        seed=("PIB", "IPCA", "EF"), growth=("IPCA", "PIB"),
    ),
    Rule(
        "c21", "21. Transferências Correntes - Recursos da Saúde",
        "Receita de 2019+PIB+IPCA. Para 2021-2023 PIB+IPCA", "S", "17",
        fund_any=("223",), months=FIRST_MONTH, years=AFTER_BASE_YEAR, seed_year=1,
        seed=(12.0, "IPCA"), growth=("IPCA", "PIB"),
    ),
    Rule(
        "c22", "22. Transferências Correntes - Convênios (transferências voluntárias)",
        "Receita de 2019+IPCA. Para 2021-2023 IPCA", "S", "17",
        fund_any=("128", "228"),
        seed=("IPCA",), growth=("IPCA",),
    ),
    Rule(
        "c23", "23. Transferências Correntes - Outras Transferências",
        "Receita de 2019+IPCA. Para 2021-2023 IPCA", "S", "17",
        fund_not_prefix=("0128", "0228", "0223"),
        name_none=(
            "FUNDEB", "CIDE", "Salário-Educação", "FNDE", "87/96", "FEX", "IPI",
            "Cota-Parte do Fundo de Participação", "12.276",
        ),
        seed=("IPCA",), growth=("IPCA",),
    ),
    Rule(
        "c24", "24. OUTRAS RECEITAS CORRENTES",
        "Receita de 2019+IPCA. Para 2021-2023 IPCA", "S", "19",
        name_none=("Recuperação", "Restituições de Convênios", "PRODEC"),
        seed=("IPCA",), growth=("IPCA",),
    ),
    # Revenues between public bodies.
    Rule(
        "c30", "30. Receitas intra-orçamentárias de contribuições",
        "13 vezes receita de janeiro para 2020. Para 2021-2023 CVFS", "N", "72",
        months=FIRST_MONTH, seed_year=1,
        seed=(13.0,), growth=("CVFS",),
    ),
    Rule(
        "c31", "31. Receitas intra-orçamentárias patrimoniais",
        "Receita de 2019+IPCA. Para 2021-2023 IPCA", "N", "73",
        seed=("IPCA",), growth=("IPCA",),
    ),
    Rule(
        "c32", "32. Receitas intra-orçamentárias de serviços",
        "Receita de 2019+CVFS. Para 2021-2023 CVFS", "N", "76",
        months=(2, 6), years=UP_TO_BASE_YEAR, collected_months=5,
        seed=(11.14, "CVFS"), growth=("CVFS",),
    ),
    Rule(
        "c32_budget", "32. Receitas intra-orçamentárias de serviços",
        "Receita de 2019+CVFS. Para 2021-2023 CVFS", "N", "76",
        months=FIRST_MONTH, years=AFTER_BASE_YEAR, collected=NONE,
        seed=(11.14, "CVFS"), growth=("CVFS",),
    ),
    Rule(
        "c33", "33. Receitas intra-orçamentárias - outras receitas correntes\n",
        "Receita de 2019+IPCA. Para 2021-2023 IPCA", "N", "79",
        name_none=("Recuperação",),
        seed=("IPCA",), growth=("IPCA",),
    ),
    # Contractual additions and capital revenues.
    Rule(
        "prodec", "24. OUTRAS RECEITAS CORRENTES",
        "Informações do FADESC sobre arrecadação para 2020. Para o período 2021-2023 reajustado por "
        "PIB+IPCA",
        "N", "19",
        name_any=("PRODEC",),
        seed=None, growth=None,
    ),
    Rule(
        "capital_loans", "Operações de crédito",
        "Informações da DICD sobre operações de crédito contratadas para os próximos 3 anos", "N", "21",
        seed=None, growth=None,
    ),
    Rule(
        "capital_disposals", "Alienação de bens", "IPCA", "N", "22",
        name_any=("Poder Executivo",),
        seed=("IPCA",), growth=("IPCA",),
    ),
    Rule(
        "capital_amortisation", "Amortização de empréstimos", "IPCA", "N", "23",
        seed=("IPCA",), growth=("IPCA",),
    ),
    Rule(
        "capital_transfers", "Transferências de capital ", "IPCA", "N", "24",
        seed=("IPCA",), growth=("IPCA",),
    ),
    Rule(
        "capital_other", "Outras Receitas de Capital", "IPCA", "N", "89",
        seed=("IPCA",), growth=("IPCA",),
    ),
)

# An actual slice and the budget slice that is stacked onto it.
STACKED_PAIRS = {
    "c03": ("c03a", "c03b"),
    "c12b": ("c12b", "c12b_budget"),
    "c17": ("c17", "c17_budget"),
    "c32": ("c32", "c32_budget"),
}


def rule_by_id(slice_id: str) -> Rule:
    return {rule.slice_id: rule for rule in CATALOGUE}[slice_id]
