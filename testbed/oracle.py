"""DuckDB statements that state each query's expected result.

Conditions, seeds and growth formulas are written out here a second time, in
SQL, as are the texts and prefixes; nothing is taken from the rule catalogue.
"""

from __future__ import annotations

from testbed.lineitem_fact import fact_sql, sql_text

KEYS = (
    "cod_unidade_gestora, cod_conta_contabil, cod_origem, cod_fonte_recurso, "
    "cod_detalhamento, nom_detalhamento, num_ano"
)
PROJECTIONS = ", ".join(f"projecao_receita_arrecadada_liquida{year}" for year in range(2020, 2024))
STACKED = f"{KEYS}, receita_arrecadada_liquida, receita_orcada_liquida, nome_receita_ldo, memoria_calculo, {PROJECTIONS}, ldo"

# Fixed values, stated a second time: label, memo and ldo of each slice.
TEXTS = {
    "c01": (
        "1.IRRF",
        "Crescimento vegetativo da folha de salários",
        "S",
    ),
    "c02": (
        "2.IPVA",
        "Dados da ANFAVEA. Para 2021-2023 PIB+IPCA+3%desvalorização",
        "S",
    ),
    "c03a": (
        "3.ITCMD",
        "2º Semestre de 2019 x 2. Para 2021-2023 utilizado IPCA",
        "S",
    ),
    "c03b": (
        "3.ITCMD",
        "2º Semestre de 2019 x 2. Para 2021-2023 utilizado IPCA",
        "S",
    ),
    "c04": (
        "4.ICMS",
        "Execução2019+PIB+IPCA+EF. Para 2021-2023 utilizado PIB+IPCA. EF igualado a zero.",
        "S",
    ),
    "c05": (
        "5.Taxas",
        "Receita executada de 2019+IPCA+PIB",
        "S",
    ),
    "c06": (
        "6.Outras receitas tributárias",
        "Receita executada de 2019+IPCA+PIB+Esforço Fiscal. Para 2021-2023 IPCA+PIB. EF igualado a zero",
        "S",
    ),
    "c07": (
        "7.Contribuições",
        "Receita executada de 2019+CVFS-2% (A receita de contribuições tem crescido a uma taxa mais baixa que CVFS. Para 2021-2023 CVFS",
        "S",
    ),
    "c08": (
        "8.Receita Patrimonial - Rendimento de aplicações financeiras",
        "Receita executada de 2019+IPCA+Aumento da SELIC. Para 2021-2023 IPCA+SELIC.",
        "S",
    ),
    "c09": (
        " 9.Receita Patrimonial - Não financeiras",
        "Início de 2020 x 12. Para 2021-2023 IPCA.",
        "S",
    ),
    "c10": (
        " 10. Receita Agropecuária",
        "Receita executada de 2019+PIB+IPCA. Para 2021-2023 PIB+IPCA.",
        "S",
    ),
    "c11": (
        "11. Receita Industrial",
        "Receita executada de 2019+PIB+IPCA. Para 2021-2023 PIB+IPCA",
        "S",
    ),
    "c12a": (
        "12. Receita de Serviços",
        "Para contribuições: CVFS. Para os demais PIB+IPCA",
        "S",
    ),
    "c12b": (
        "12. Receita de Serviços",
        "Para contribuições: CVFS. Para os demais PIB+IPCA",
        "S",
    ),
    "c12b_budget": (
        "12. Receita de Serviços",
        "Para contribuições: CVFS. Para os demais PIB+IPCA",
        "S",
    ),
    "c12c": (
        "12. Receita de Serviços",
        "Para contribuições: CVFS. Para os demais PIB+IPCA",
        "S",
    ),
    "c13": (
        "13. Transferências Correntes - Cota-Parte do Fundo Participação Estado e DF ",
        "Receita de 2019 corrigida por PIB+IPCA. Para 2021-2023 PIB+IPCA",
        "S",
    ),
    "c14": (
        "14. Transferências Correntes - Cota-Parte do IPI",
        "Receita executada de 2019+PIB+IPCA. Para 2021-2023 PIB+IPCA",
        "S",
    ),
    "c15": (
        "15. Transferências Correntes - Outras Transferências da União - FEX (Aux. Fom.Export) Tesouro",
        "Legislação Federal - União interrompeu o envio da FEX",
        "S",
    ),
    "c16": (
        "16. Transferências Correntes - Transf. Financeiras do ICMS - Desoneração - L.C. N. 87/96",
        "Legislação Federal",
        "S",
    ),
    "c17": (
        "17. Transferências Correntes - Outras Transferências Dir. Fundo Nacional do Desenv. da Educação - FNDE",
        "Fevereiro de 2020 vezes 10 apenas para a parte de alimentação (PNAE). A de obras foi zerada por falta de visibilidade na receita.",
        "S",
    ),
    "c17_budget": (
        "17. Transferências Correntes - Outras Transferências Dir. Fundo Nacional do Desenv. da Educação - FNDE",
        "Fevereiro de 2020 vezes 10 apenas para a parte de alimentação (PNAE). A de obras foi zerada por falta de visibilidade na receita.",
        "S",
    ),
    "c18": (
        "18. Transferências Correntes - Transferências do Salário-Educação",
        "receita de 2019 + IPCA. Para 2021-2023 IPCA",
        "S",
    ),
    "c19": (
        "19. Transferências Correntes - Cota-Parte CIDE - Contrib. Intervenção no Domínio Econômico",
        "Receita de 2019 corrigido pelo IPCA + PIB. Para 2021-2023 PIB+IPCA",
        "S",
    ),
    "c20": (
        "20. Transferências Correntes - Transferências de Recursos do FUNDEB",
        "Receita de 2019+IPCA+PIB+EF+ previsão de que o coeficiente município/estado será estável nos próximos ano. Para 2021-2023 PIB+IPCA",
        "S",
    ),
    "c21": (
        "21. Transferências Correntes - Recursos da Saúde",
        "Receita de 2019+PIB+IPCA. Para 2021-2023 PIB+IPCA",
        "S",
    ),
    "c22": (
        "22. Transferências Correntes - Convênios (transferências voluntárias)",
        "Receita de 2019+IPCA. Para 2021-2023 IPCA",
        "S",
    ),
    "c23": (
        "23. Transferências Correntes - Outras Transferências",
        "Receita de 2019+IPCA. Para 2021-2023 IPCA",
        "S",
    ),
    "c24": (
        "24. OUTRAS RECEITAS CORRENTES",
        "Receita de 2019+IPCA. Para 2021-2023 IPCA",
        "S",
    ),
    "c30": (
        "30. Receitas intra-orçamentárias de contribuições",
        "13 vezes receita de janeiro para 2020. Para 2021-2023 CVFS",
        "N",
    ),
    "c31": (
        "31. Receitas intra-orçamentárias patrimoniais",
        "Receita de 2019+IPCA. Para 2021-2023 IPCA",
        "N",
    ),
    "c32": (
        "32. Receitas intra-orçamentárias de serviços",
        "Receita de 2019+CVFS. Para 2021-2023 CVFS",
        "N",
    ),
    "c32_budget": (
        "32. Receitas intra-orçamentárias de serviços",
        "Receita de 2019+CVFS. Para 2021-2023 CVFS",
        "N",
    ),
    "c33": (
        "33. Receitas intra-orçamentárias - outras receitas correntes\n",
        "Receita de 2019+IPCA. Para 2021-2023 IPCA",
        "N",
    ),
    "prodec": (
        "24. OUTRAS RECEITAS CORRENTES",
        "Informações do FADESC sobre arrecadação para 2020. Para o período 2021-2023 reajustado por PIB+IPCA",
        "N",
    ),
    "capital_loans": (
        "Operações de crédito",
        "Informações da DICD sobre operações de crédito contratadas para os próximos 3 anos",
        "N",
    ),
    "capital_disposals": (
        "Alienação de bens",
        "IPCA",
        "N",
    ),
    "capital_amortisation": (
        "Amortização de empréstimos",
        "IPCA",
        "N",
    ),
    "capital_transfers": (
        "Transferências de capital ",
        "IPCA",
        "N",
    ),
    "capital_other": (
        "Outras Receitas de Capital",
        "IPCA",
        "N",
    ),
}

# Fixed values, stated a second time: pairs of an actual and a budget slice, and the prefix lists.
PAIRS = {
    "c03": ("c03a", "c03b"),
    "c12b": ("c12b", "c12b_budget"),
    "c17": ("c17", "c17_budget"),
    "c32": ("c32", "c32_budget"),
}
RCL_PREFIXES = (
    "1118021", "1118012", "1118013", "111303", "1118014", "112", "113", "13", "14", "15", "16", "1718011",
    "1718061", "1718016", "17580111", "1718017", "1718018", "171802", "171803", "171812", "171805", "171807",
    "1728", "173", "175899", "174", "176", "177", "17181", "19", "22200012",
)
RLI_PREFIXES = (
    "1118021", "11180212", "11180214", "11180213", "11180131", "11180132", "11180133", "11180134", "11180121",
    "11180122", "11180123", "11180124", "111303", "1718011", "171806", "1718016", "1718018",
)


# Parameters as doubles (the exponent keeps DuckDB from reading decimals).
GIVEN = {
    "ipca": {20: "1.0305", 21: "1.0357", 22: "1.035", 23: "1.035"},
    "pib": {20: "1.0002", 21: "1.025", 22: "1.025", 23: "1.025"},
    "ef": {20: "1", 21: "1", 22: "1", 23: "1"},
    "cvfs": {20: "1.05", 21: "1.05", 22: "1.05", 23: "1.05"},
    "frota": {20: "0.97"},
    "covid": {20: "1", 21: "1", 22: "1", 23: "1"},
    "selic": {19: "0.065", 20: "0.0375", 21: "0.0525", 22: "0.06", 23: "0.0625"},
    "interno": {20: "262799084", 21: "512000000", 22: "550000000", 23: "0"},
    "externo": {20: "37695571", 21: "0", 22: "0", 23: "0"},
}
REVISED = {
    "ipca": {20: "1.031", 21: "1.042", 22: "1.053", 23: "1.064"},
    "pib": {20: "1.011", 21: "1.022", 22: "1.033", 23: "1.044"},
    "ef": {20: "1.071", 21: "1.082", 22: "1.093", 23: "1.104"},
    "cvfs": {20: "1.115", 21: "1.126", 22: "1.137", 23: "1.148"},
    "frota": {20: "0.96"},
    "covid": {20: "0.91", 21: "0.92", 22: "0.93", 23: "0.94"},
    "selic": {19: "0.061", 20: "0.052", 21: "0.043", 22: "0.074", 23: "0.085"},
    "interno": {20: "15000000", 21: "16000000", 22: "17000000", 23: "18000000"},
    "externo": {20: "11000000", 21: "12000000", 22: "13000000", 23: "14000000"},
}


def parameters(given: dict[str, dict[int, str]]) -> str:
    values = ", ".join(f"{v}e0 AS {name}{year}" for name, years in given.items() for year, v in years.items())
    return f"""
given AS (SELECT {values}),
par AS (SELECT *,
  ipca21 * pib21 * 0.97e0 AS frota21, ipca22 * pib22 * 0.97e0 AS frota22,
  ipca22 * pib22 * 0.97e0 AS frota23,
  selic21 / selic20 AS juros21, selic22 / selic21 AS juros22, selic23 / selic22 AS juros23
  FROM given)"""


REVENUE_ACCOUNT = (
    "(contains(cod_conta_contabil, '521') OR regexp_matches(cod_conta_contabil, '^(62121|62131|62132)'))"
)
NET_COLLECTED = "sum(val_receita_arrecadada) - sum(val_receita_arrecadada_deducao)"
NET_BUDGET = "sum(val_receita_orcada) - sum(val_receita_orcada_deducao)"
LARGEST_COLLECTED = "max(val_receita_arrecadada) - max(val_receita_arrecadada_deducao)"
NOTHING = "0"

PENALTY = "regexp_matches(nom_detalhamento, 'Juro|Multa|Dívida Ativa')"
JANUARY = "num_mes <= 1"


def name_has(pattern: str) -> str:
    return f"regexp_matches(nom_detalhamento, '{pattern}')"


def growth(*steps: str) -> list[str]:
    """Formulas for 2021 to 2023 from one formula with a year placeholder."""
    return [" * ".join(step.replace("#", year) for step in steps) for year in ("21", "22", "23")]


IPCA = growth("ipca#")
IPCA_PIB = growth("ipca#", "pib#")
CVFS = growth("cvfs#")
FROM_2019 = 2019
FROM_2020 = 2020

# slice: condition, net collected, scaling (x stands for the amount), net budget, seed year, seed, growth
SLICES = {
    "c01": (f"cod_origem = '11' AND {name_has('Imposto sobre a Renda')} AND NOT {PENALTY}",
            NET_COLLECTED, "x", NET_BUDGET, FROM_2019, "x * cvfs20", CVFS),
    "c02": (f"cod_origem = '11' AND {name_has('IPVA')} AND NOT {PENALTY}",
            NET_COLLECTED, "x", NET_BUDGET, FROM_2019, "x * frota20", growth("frota#")),
    "c03a": (f"cod_origem = '11' AND {name_has('ITCMD')} AND NOT {PENALTY} AND num_mes > 6",
             NET_COLLECTED, "x", NOTHING, FROM_2019, "x * 2", IPCA),
    "c03b": (f"cod_origem = '11' AND {name_has('ITCMD')} AND NOT {PENALTY} AND {JANUARY}",
             NOTHING, "x", NET_BUDGET, FROM_2019, "x * 2", IPCA),
    "c04": (f"cod_origem = '11' AND {name_has('ICMS')} AND NOT {PENALTY} "
            "AND NOT contains(cod_conta_contabil, '62131020201')",
            NET_COLLECTED, "x", NET_BUDGET, FROM_2019, "x * ipca20 * pib20 * ef20", growth("pib#", "ipca#")),
    "c05": (f"cod_origem = '11' AND NOT {name_has('ITBI|ITCMD|IPVA|ICMS|Imposto sobre a Renda')} "
            f"AND NOT {PENALTY}",
            NET_COLLECTED, "x", NET_BUDGET, FROM_2019, "x * ipca20 * pib20", IPCA_PIB),
    "c06": (f"cod_origem = '11' AND {PENALTY}",
            NET_COLLECTED, "x", NET_BUDGET, FROM_2019, "x * ipca20 * ef20 * pib20", IPCA_PIB),
    "c07": ("cod_origem = '12'",
            NET_COLLECTED, "x", NET_BUDGET, FROM_2019, "x * (cvfs20 - 0.02e0)", CVFS),
    "c08": (f"cod_origem = '13' AND {name_has('Remuneração')}",
            NET_COLLECTED, "x", NET_BUDGET, FROM_2019, "x * ipca20", growth("ipca#", "juros#")),
    "c09": (f"cod_origem = '13' AND NOT {name_has('Remuneração')} AND {JANUARY} AND num_ano >= 2020",
            NET_COLLECTED, "x", NET_BUDGET, FROM_2020, "x * ipca20", IPCA),
    "c10": ("cod_origem = '14'", NET_COLLECTED, "x", NET_BUDGET, FROM_2019, "x * ipca20 * pib20", IPCA_PIB),
    "c11": ("cod_origem = '15'", NET_COLLECTED, "x", NET_BUDGET, FROM_2019, "x * ipca20 * pib20", IPCA_PIB),
    "c12a": (f"cod_origem = '16' AND {name_has('Contribuição')}",
             NET_COLLECTED, "x", NET_BUDGET, FROM_2019, "x * cvfs20", CVFS),
    "c12b": (f"cod_origem = '16' AND {name_has('SUS')} AND num_mes > 7",
             NET_COLLECTED, "12 * (x / 5)", NET_BUDGET, FROM_2019, "x", IPCA_PIB),
    "c12b_budget": (f"cod_origem = '16' AND {name_has('SUS')} AND {JANUARY}",
                    NOTHING, "x", NET_BUDGET, FROM_2019, "x", IPCA_PIB),
    "c12c": (f"cod_origem = '16' AND NOT {name_has('SUS|Contribuição')}",
             NET_COLLECTED, "x", NET_BUDGET, FROM_2019, "x * ipca20 * pib20", IPCA_PIB),
    "c13": (f"cod_origem = '17' AND {name_has('Cota-Parte do Fundo de Participação')}",
            NET_COLLECTED, "x", NET_BUDGET, FROM_2019, "x * ipca20 * pib20", IPCA_PIB),
    "c14": (f"cod_origem = '17' AND {name_has('IPI')}",
            NET_COLLECTED, "x", NET_BUDGET, FROM_2019, "x * ipca20 * pib20", IPCA_PIB),
    "c15": (f"cod_origem = '17' AND {name_has('FEX')}",
            NET_COLLECTED, "x", NET_BUDGET, FROM_2019, "0", ["0", "0", "0"]),
    "c16": (f"cod_origem = '17' AND {name_has('87/96')}",
            LARGEST_COLLECTED, "x", NET_BUDGET, FROM_2019, "x * 0", growth("ipca#", "pib#", "0")),
    "c17": (f"cod_origem = '17' AND {name_has('FNDE')} AND num_mes = 2",
            NET_COLLECTED, "x", NET_BUDGET, FROM_2020, "10 * x", IPCA),
    "c17_budget": (f"cod_origem = '17' AND {name_has('FNDE')} AND {JANUARY}",
                   NOTHING, "x", NET_BUDGET, FROM_2020, "10 * x", IPCA),
    "c18": (f"cod_origem = '17' AND {name_has('Salário-Educação')}",
            NET_COLLECTED, "x", NET_BUDGET, FROM_2019, "x * ipca20 * covid20", growth("ipca#", "covid#")),
    "c19": (f"cod_origem = '17' AND {name_has('CIDE')}",
            NET_COLLECTED, "x", NET_BUDGET, FROM_2019, "x * ipca20 * pib20", IPCA_PIB),
    "c20": (f"cod_origem = '17' AND {name_has('FUNDEB')}",
            NET_COLLECTED, "x", NET_BUDGET, FROM_2019, "x * pib20 * ipca20 * ef20", IPCA_PIB),
    "c21": (f"cod_origem = '17' AND contains(cod_fonte_recurso, '223') AND {JANUARY} AND num_ano >= 2020",
            NET_COLLECTED, "x", NET_BUDGET, FROM_2020, "12 * x * ipca20", IPCA_PIB),
    "c22": ("cod_origem = '17' AND regexp_matches(cod_fonte_recurso, '128|228')",
            NET_COLLECTED, "x", NET_BUDGET, FROM_2019, "x * ipca20", IPCA),
    "c23": ("cod_origem = '17' AND NOT regexp_matches(cod_fonte_recurso, '^(0128|0228|0223)') AND NOT "
            + name_has("FUNDEB|CIDE|Salário-Educação|FNDE|87/96|FEX|IPI|"
                       r"Cota-Parte do Fundo de Participação|12\.276"),
            NET_COLLECTED, "x", NET_BUDGET, FROM_2019, "x * ipca20", IPCA),
    "c24": (f"cod_origem = '19' AND NOT {name_has('Recuperação|Restituições de Convênios|PRODEC')}",
            NET_COLLECTED, "x", NET_BUDGET, FROM_2019, "x * ipca20", IPCA),
    "c30": (f"cod_origem = '72' AND {JANUARY}",
            NET_COLLECTED, "x", NET_BUDGET, FROM_2020, "13 * x", CVFS),
    "c31": ("cod_origem = '73'", NET_COLLECTED, "x", NET_BUDGET, FROM_2019, "x * ipca20", IPCA),
    "c32": ("cod_origem = '76' AND num_mes BETWEEN 2 AND 6 AND num_ano <= 2019",
            NET_COLLECTED, "x / 5", NET_BUDGET, FROM_2019, "x * 11.14e0 * cvfs20", CVFS),
    "c32_budget": (f"cod_origem = '76' AND {JANUARY} AND num_ano >= 2020",
                   NOTHING, "x", NET_BUDGET, FROM_2019, "x * 11.14e0 * cvfs20", CVFS),
    "c33": (f"cod_origem = '79' AND NOT {name_has('Recuperação')}",
            NET_COLLECTED, "x", NET_BUDGET, FROM_2019, "x * ipca20", IPCA),
    "prodec": (f"cod_origem = '19' AND {name_has('PRODEC')}",
               NET_COLLECTED, "x", NET_BUDGET, FROM_2019, "0", ["0", "0", "0"]),
    "capital_loans": ("cod_origem = '21'",
                      NET_COLLECTED, "x", NET_BUDGET, FROM_2019, "0", ["0", "0", "0"]),
    "capital_disposals": (f"cod_origem = '22' AND {name_has('Poder Executivo')}",
                          NET_COLLECTED, "x", NET_BUDGET, FROM_2019, "x * ipca20", IPCA),
    "capital_amortisation": ("cod_origem = '23'",
                             NET_COLLECTED, "x", NET_BUDGET, FROM_2019, "x * ipca20", IPCA),
    "capital_transfers": ("cod_origem = '24'",
                          NET_COLLECTED, "x", NET_BUDGET, FROM_2019, "x * ipca20", IPCA),
    "capital_other": ("cod_origem = '89'",
                      NET_COLLECTED, "x", NET_BUDGET, FROM_2019, "x * ipca20", IPCA),
}

MANUAL_ROWS = f"""
SELECT '520099' AS cod_unidade_gestora, '62121000000' AS cod_conta_contabil, '16' AS cod_origem,
  '0160000000' AS cod_fonte_recurso, '1360011101' AS cod_detalhamento,
  'Cessão Direito de Operacionalização da Folha Pagto de Pessoal -Adm. Direta -P. Executivo' AS nom_detalhamento,
  2019 AS num_ano, 0e0 AS receita_arrecadada_liquida, 0e0 AS receita_orcada_liquida,
  ' 9.Receita Patrimonial - Não financeiras' AS nome_receita_ldo,
  'Informação Luiz sobre contrato BB' AS memoria_calculo,
  30316775.769e0 AS projecao_receita_arrecadada_liquida2020,
  30316775.769e0 AS projecao_receita_arrecadada_liquida2021,
  30316775.769e0 AS projecao_receita_arrecadada_liquida2022,
  0e0 AS projecao_receita_arrecadada_liquida2023, 'S' AS ldo
UNION ALL
SELECT '520091', '62121000000', '19', '0299000000', '1990992101', 'Acréscimos Contratuais PRODEC', 2019,
  0e0, 0e0, '24. OUTRAS RECEITAS CORRENTES', 'Informações do FADESC sobre arrecadação para 2020',
  28962264e0, 28962264e0 * ipca21, 28962264e0 * ipca21 * ipca22, 28962264e0 * ipca21 * ipca22 * ipca23, 'N'
FROM par
UNION ALL
SELECT '520099', '62121000000', '21', '0191000000', '2119001100', 'Espaço Fiscal', 2019,
  0e0, 0e0, 'Operações de crédito', 'Informações da GEDIP sobre espaço fiscal do Estado',
  interno20, interno21, interno22, interno23, 'N' FROM par
UNION ALL
SELECT '520099', '62121000000', '21', '0192000000', '2128015100', 'BID/CAF/PROFISCO...', 2019,
  0e0, 0e0, 'Operações de crédito', 'Informações da GEDIP', externo20, externo21, externo22, externo23, 'N' FROM par"""


def slice_select(slice_id: str) -> str:
    condition, collected, scaling, budget, seed_year, seed, steps = SLICES[slice_id]
    label, memo, ldo = TEXTS[slice_id]
    amount = "receita_arrecadada_liquida"
    return f"""
SELECT {KEYS}, receita_arrecadada_liquida, receita_orcada_liquida,
  {sql_text(label)} AS nome_receita_ldo, {sql_text(memo)} AS memoria_calculo,
  CASE WHEN num_ano = {seed_year} THEN cast({seed.replace('x', amount)} AS double) ELSE 0e0 END
    AS projecao_receita_arrecadada_liquida2020,
  projecao_receita_arrecadada_liquida2020 * {steps[0]} AS projecao_receita_arrecadada_liquida2021,
  projecao_receita_arrecadada_liquida2021 * {steps[1]} AS projecao_receita_arrecadada_liquida2022,
  projecao_receita_arrecadada_liquida2022 * {steps[2]} AS projecao_receita_arrecadada_liquida2023,
  {sql_text(ldo)} AS ldo
FROM (SELECT {KEYS}, {scaling.replace('x', 'bruto')} AS receita_arrecadada_liquida, receita_orcada_liquida
      FROM (SELECT {KEYS}, cast({collected} AS double) AS bruto,
              cast({budget} AS double) AS receita_orcada_liquida
            FROM fat WHERE {REVENUE_ACCOUNT} AND {condition} GROUP BY {KEYS}) AS grouped) AS scaled, par"""


def with_fact(body: str, *more: str, given: dict[str, dict[int, str]] = GIVEN) -> str:
    return "WITH " + ",".join([fact_sql(), parameters(given), *more]) + "\n" + body


def all_slices() -> str:
    return "\nUNION ALL\n".join(slice_select(slice_id) for slice_id in SLICES)


def with_stacked(body: str, *more: str, given: dict[str, dict[int, str]] = GIVEN) -> str:
    """Body over ``stacked``: all slices and the manual rows."""
    stacked = f"stacked AS MATERIALIZED ({all_slices()}\nUNION ALL\n{MANUAL_ROWS})"
    return with_fact(body, stacked, *more, given=given)


RELABELLED = "CASE WHEN starts_with(cod_conta_contabil, '621') THEN 2020 ELSE num_ano END AS num_ano"
ONE_FUND = (
    "CASE WHEN cod_fonte_recurso IN ('0161000000', '0162000000') THEN '0100000000' "
    "ELSE cod_fonte_recurso END AS cod_fonte_recurso"
)
IS_RCL = f"regexp_matches(cod_detalhamento, '^({'|'.join(RCL_PREFIXES)})')"
IS_RLI = (
    f"regexp_matches(cod_detalhamento, '^({'|'.join(RLI_PREFIXES)})') "
    "AND NOT regexp_matches(cod_conta_contabil, '^(6213101|521120101)')"
)
RCL = f"CASE WHEN {IS_RCL} THEN 'S' ELSE '' END AS rcl"
RLI = f"CASE WHEN {IS_RLI} THEN 'S' ELSE '' END AS \"RLI\""
CODES = "left(cod_fonte_recurso, 4) AS cod_fonte_reduzida, substring(cod_fonte_recurso, 3, 2) AS cod_tipo_fr"
DEFLATED = """
  receita_orcada_liquida / ipca20 AS "projecao2020aValoresDe2019",
  projecao_receita_arrecadada_liquida2021 / (ipca20 * ipca21) AS "projecao2021aValoresDe2019",
  projecao_receita_arrecadada_liquida2022 / (ipca20 * ipca21 * ipca22) AS "projecao2022aValoresDe2019",
  projecao_receita_arrecadada_liquida2023 / (ipca20 * ipca21 * ipca22 * ipca23)
    AS "projecao2023aValoresDe2019\""""


def consolidated(given: dict[str, dict[int, str]] = GIVEN) -> str:
    texts = "cod_unidade_gestora, cod_conta_contabil, cod_origem"
    return with_stacked(
        f"""
SELECT {KEYS}, receita_arrecadada_liquida AS valor_base, receita_orcada_liquida, nome_receita_ldo,
  memoria_calculo, {PROJECTIONS}, ldo, {RCL}, {RLI}, {CODES}, {DEFLATED}
FROM (SELECT {texts}, {ONE_FUND}, cod_detalhamento, nom_detalhamento, {RELABELLED},
        receita_arrecadada_liquida, receita_orcada_liquida, nome_receita_ldo, memoria_calculo,
        {PROJECTIONS}, ldo
      FROM stacked) AS adjusted, par""",
        given=given,
    )


def audit() -> str:
    prefixes = ", ".join(
        f"('{flag}', {ord_}, '{prefix}')"
        for flag, items in (("rcl", RCL_PREFIXES), ("RLI", RLI_PREFIXES))
        for ord_, prefix in enumerate(items, 1)
    )
    return with_stacked(
        """
SELECT p.flag, p.ord, p.prefix,
  (SELECT count(*) FROM stacked AS s
   WHERE EXISTS (SELECT 1 FROM prefixes AS q
                 WHERE q.flag = p.flag AND q.ord <= p.ord
                   AND starts_with(s.cod_detalhamento, q.prefix))) AS matched_rows
FROM prefixes AS p""",
        f"prefixes AS (SELECT * FROM (VALUES {prefixes}) AS t(flag, ord, prefix))",
    )


INDEX_ROWS = "\nUNION ALL ".join(
    f"SELECT '{indicator}' AS indicator, 20{year} AS ref_year, {name}{year} AS value FROM par"
    for indicator, name in (
        ("IPCA", "ipca"), ("PIB", "pib"), ("EF", "ef"), ("CVFS", "cvfs"), ("ANFAVEA", "frota"), ("COVID_EMPREGO", "covid"),
    )
    for year in (20, 21, 22, 23)
)

BY_ORIGIN = f"""
SELECT num_ano, cod_origem, cast({NET_COLLECTED} AS double) AS receita_arrecadada_liquida
FROM fat WHERE {REVENUE_ACCOUNT} GROUP BY num_ano, cod_origem"""


GDP = """
SELECT 2017 AS ref_year, 275400000000e0 AS nominal_gdp
UNION ALL SELECT 2018, 298381000000e0 UNION ALL SELECT 2019, 317300000000e0
UNION ALL SELECT 2020, 317300000000e0 * (pib20 * ipca20) FROM par
UNION ALL SELECT 2021, 317300000000e0 * ((pib20 * ipca20) * (pib21 * ipca21)) FROM par
UNION ALL SELECT 2022, 317300000000e0 * ((pib20 * ipca20) * (pib21 * ipca21) * (pib22 * ipca22)) FROM par
UNION ALL SELECT 2023, 317300000000e0
  * ((pib20 * ipca20) * (pib21 * ipca21) * (pib22 * ipca22) * (pib23 * ipca23)) FROM par"""
GDP_KNOWN_LATER = """
SELECT 2017 AS ref_year, 275400000000e0 AS nominal_gdp
UNION ALL SELECT 2018, 298381000000e0 UNION ALL SELECT 2019, 317300000000e0
UNION ALL SELECT 2020, 317300000000e0 * (pib20 * ipca20) FROM par
UNION ALL SELECT 2021, 400000000000e0
UNION ALL SELECT 2022, 400000000000e0 * (pib22 * ipca22) FROM par
UNION ALL SELECT 2023, 400000000000e0 * ((pib22 * ipca22) * (pib23 * ipca23)) FROM par"""


def gdp_beside_collection(gdp: str) -> str:
    return with_fact(
        f"""
SELECT coalesce(g.ref_year, y.num_ano) AS ref_year, g.nominal_gdp, y.receita_arrecadada_liquida
FROM ({gdp}) AS g
FULL JOIN (SELECT num_ano, cast({NET_COLLECTED} AS double) AS receita_arrecadada_liquida
           FROM fat WHERE {REVENUE_ACCOUNT} GROUP BY num_ano) AS y ON y.num_ano = g.ref_year"""
    )


def text_amounts() -> str:
    sums = ", ".join(
        f"cast(sum(cast({c} AS decimal(20,4)) + 0.0004) AS decimal(30,4)) AS {c}"
        for c in ("val_receita_arrecadada", "val_receita_arrecadada_deducao", "val_receita_orcada",
                  "val_receita_orcada_deducao")
    )
    return with_fact(f"SELECT {KEYS}, {sums} FROM fat GROUP BY {KEYS}")


FINGERPRINT = """
SELECT nome_receita_ldo, count(*) AS linhas, true AS igual, count(DISTINCT r) > 1 AS swapped, true AS changed, true AS lost
FROM (SELECT nome_receita_ldo, r FROM ({}) AS r) AS rows GROUP BY nome_receita_ldo"""

SETS = f"""
sets AS (SELECT *, list_filter([{", ".join(f"CASE WHEN {parts[0]} THEN '{slice_id}' END" for slice_id, parts in SLICES.items())}],
    lambda x: x IS NOT NULL) AS ids FROM fat WHERE {REVENUE_ACCOUNT})"""

COVERAGE = f"""
SELECT array_to_string(ids, '+') AS slices, cast(len(any_value(ids)) AS int) AS times, count(*) AS entries,
  cast({NET_COLLECTED} AS double) AS receita_arrecadada_liquida, cast({NET_BUDGET} AS double) AS receita_orcada_liquida
FROM sets GROUP BY array_to_string(ids, '+')"""


def reconciliation() -> str:
    lines = ("accounts", "1"), ("slices", "len(ids)"), ("repeated", "greatest(len(ids) - 1, 0)"), ("uncovered", "cast(len(ids) = 0 AS int)")
    parts = [
        f"SELECT {n} AS ord, '{name}' AS line, cast(sum({times}) AS bigint) AS entries, "
        f"sum({times} * (val_receita_arrecadada - val_receita_arrecadada_deducao)) AS a, "
        f"sum({times} * (val_receita_orcada - val_receita_orcada_deducao)) AS b FROM sets"
        for n, (name, times) in enumerate(lines, 1)
    ]
    columns = "cast(a AS double) AS receita_arrecadada_liquida, cast(b AS double) AS receita_orcada_liquida"
    signed = ", ".join(f"cast(sum(CASE WHEN line IN ('accounts', 'repeated') THEN {x} ELSE -{x} END) AS {t})"
                       for x, t in (("entries", "bigint"), ("a", "double"), ("b", "double")))
    return with_fact(
        f"SELECT ord, line, entries, {columns} FROM lines UNION ALL SELECT 5, 'difference', {signed} FROM lines",
        SETS, "lines AS (" + " UNION ALL ".join(parts) + ")",
    )


def prefix_match() -> str:
    picks = []
    for name, prefixes in (("rcl", RCL_PREFIXES), ("rli", RLI_PREFIXES)):
        ords = "".join(f" WHEN starts_with(cod_detalhamento, '{prefix}') THEN {n}" for n, prefix in enumerate(prefixes, 1))
        texts = "".join(f" WHEN starts_with(cod_detalhamento, '{prefix}') THEN '{prefix}'" for prefix in prefixes)
        picks += [f"CASE{ords} END AS {name}_ord", f"CASE{texts} END AS {name}_prefix"]
    return with_stacked(f"SELECT nome_receita_ldo, cod_detalhamento, {', '.join(picks)} FROM stacked")


# What format_number and the swap of marks make of non-negative amounts with two decimals.
FORMAT_PROFILE = "\nUNION ALL ".join(
    f"""SELECT '{c}' AS "column", cast(0 AS bigint) AS plain, count(*) FILTER ({point}) AS point_decimal,
  count(*) FILTER (NOT {point}) AS comma_decimal, cast(0 AS bigint) AS open_point, cast(0 AS bigint) AS open_comma,
  cast(0 AS bigint) AS empty, cast(0 AS bigint) AS unreadable, cast(sum({c}) AS decimal(30,2)) AS soma FROM fat"""
    for c, point in (("val_receita_arrecadada", "false"), ("val_receita_arrecadada_deducao", "false"),
                     ("val_receita_orcada", "true"), ("val_receita_orcada_deducao", "true"))
)


def scenarios() -> str:
    parts = [
        f"SELECT '{name}' AS cenario, * FROM ({consolidated(given)}) AS {name}" for name, given in (("publicado", GIVEN), ("revisado", REVISED))
    ]
    return "\nUNION ALL\n".join(parts)


NET_AGGREGATE = f"""
SELECT {KEYS}, cast({NET_COLLECTED} AS double) AS receita_arrecadada_liquida,
  cast({NET_BUDGET} AS double) AS receita_orcada_liquida, count(*) AS lancamentos
FROM fat WHERE {REVENUE_ACCOUNT} GROUP BY {KEYS}"""


def statements() -> dict[str, str]:
    found = {
        "fact_scan": with_fact("SELECT * FROM fat"),
        "fact_scan_text_amounts": text_amounts(),
        "account_filter": with_fact(f"SELECT * FROM fat WHERE {REVENUE_ACCOUNT}"),
        "locale_number_parse": with_fact(
            """
SELECT cod_detalhamento, num_ano, num_mes, texto, try_cast(replace(texto, ',', '.') AS double) AS valor
FROM (SELECT cod_detalhamento, num_ano, num_mes,
        CASE WHEN num_mes = 12 THEN concat('1.', replace(cast(val_receita_arrecadada AS varchar), '.', ','))
             WHEN num_mes % 2 = 0 THEN cast(val_receita_arrecadada AS varchar)
             ELSE replace(cast(val_receita_arrecadada AS varchar), '.', ',') END AS texto
      FROM fat) AS texts"""
        ),
        "net_aggregate": with_fact(NET_AGGREGATE),
        "net_aggregate_bucketed": with_fact(NET_AGGREGATE),
        "incremental_net_aggregate": with_fact(NET_AGGREGATE),
        "incremental_slices": with_fact(all_slices()),
        "slices_by_text": with_fact(all_slices()),
        "slice_coverage": with_fact(COVERAGE, SETS),
        "slice_reconciliation": reconciliation(),
        "flag_prefix_match": prefix_match(),
        "projection_scenarios": scenarios(),
        "amount_format_profile": with_fact(FORMAT_PROFILE),
        "publish_snapshot_readback": consolidated(),
        "publish_fingerprint": FINGERPRINT.format(consolidated()),
        "macro_index": with_fact(
            f"""
SELECT b.cod_origem, b.num_ano, i.indicator, i.ref_year, i.value,
  b.receita_arrecadada_liquida * i.value AS valor_indexado
FROM ({BY_ORIGIN}) AS b CROSS JOIN ({INDEX_ROWS}) AS i"""
        ),
        "nominal_gdp_chain": gdp_beside_collection(GDP),
        "nominal_gdp_chain_revised": gdp_beside_collection(GDP_KNOWN_LATER),
        "selic_ratio": with_fact(
            f"""
SELECT {KEYS}, r.ref_year, r.selic_ratio, receita_arrecadada_liquida * r.selic_ratio AS valor_corrigido
FROM ({slice_select('c08')}) AS c
JOIN (SELECT 2020 AS ref_year, selic20 / selic19 AS selic_ratio FROM par
      UNION ALL SELECT 2021, juros21 FROM par UNION ALL SELECT 2022, juros22 FROM par
      UNION ALL SELECT 2023, juros23 FROM par) AS r ON true"""
        ),
        "all_slices_single_pass": with_fact(all_slices()),
        "union_with_manual_rows": with_stacked(f"SELECT {STACKED} FROM stacked"),
        "relabel_year": with_stacked(
            f"SELECT nome_receita_ldo, cod_conta_contabil, {RELABELLED}, receita_arrecadada_liquida FROM stacked"
        ),
        "consolidate_fund": with_stacked(
            f"SELECT nome_receita_ldo, cod_conta_contabil, {ONE_FUND}, receita_arrecadada_liquida FROM stacked"
        ),
        "derive_codes": with_stacked(
            f"SELECT nome_receita_ldo, cod_fonte_recurso, {CODES} "
            f"FROM (SELECT nome_receita_ldo, {ONE_FUND} FROM stacked) AS funds"
        ),
        "flag_rcl": with_stacked(f"SELECT nome_receita_ldo, cod_detalhamento, {RCL} FROM stacked"),
        "flag_rli": with_stacked(
            f"SELECT nome_receita_ldo, cod_detalhamento, cod_conta_contabil, {RLI} FROM stacked"
        ),
        "flag_audit_counts": audit(),
        "deflate_2019": with_stacked(f"SELECT {KEYS}, nome_receita_ldo, {DEFLATED} FROM stacked, par"),
        "revenue_projection": consolidated(),
        "revenue_projection_revised_parameters": consolidated(REVISED),
        "publish_parquet_readback": consolidated(),
    }
    for slice_id in SLICES:
        found[f"slice_{slice_id}"] = with_fact(slice_select(slice_id))
    for name, pair in PAIRS.items():
        found[f"stacked_{name}"] = with_fact("\nUNION ALL\n".join(slice_select(part) for part in pair))
    return found
