"""Revenues that are known by contract and entered by hand."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from fiscus.schema import KEYS, LABEL, LDO, MEMO, YEAR, Horizon, stacked_columns
from fiscus.sources.local import literal_table
from fiscus.sources.parameters import Parameters

# What a row is worth in a calendar year.
Amount = Callable[[Parameters, int], float]


def paid_until(last_year: int, amount: float) -> Amount:
    """The same amount in every year up to the last one, nothing after it."""
    return lambda parameters, year: amount if year <= last_year else 0.0


def grown_from(first_year: int, amount: float, indicator: str) -> Amount:
    """The amount in its first year, moved by the indicator in each later one; nothing before."""

    def worth(parameters: Parameters, year: int) -> float:
        if year < first_year:
            return 0.0
        value = amount
        for step in range(first_year + 1, year + 1):
            value = value * parameters.value(indicator, step)
        return value

    return worth


def indicated(indicator: str) -> Amount:
    """The value of the indicator in that year."""
    return lambda parameters, year: parameters.value(indicator, year)


@dataclass(frozen=True)
class ManualRow:
    """A revenue that no fact row shows; its amounts go by calendar year, whatever the horizon."""

    unit: str
    account: str
    origin: str
    fund: str
    nature: str
    name: str
    label: str
    memo: str
    ldo: str
    amount: Amount


# The payroll contract, its months, and its last paid year;
# first year and amount of the PRODEC contracts; texts of the four rows.
PAYROLL_CONTRACT = 101055919.23
PAYROLL_CONTRACT_MONTHS = 40
PAYROLL_LAST_YEAR = 2022
PRODEC_FIRST_YEAR = 2020
PRODEC_FIRST_AMOUNT = 28962264.0

MANUAL_ROWS = (
    ManualRow(
        "520099", "62121000000", "16", "0160000000", "1360011101",
        "Cessão Direito de Operacionalização da Folha Pagto de Pessoal -Adm. Direta -P. Executivo",
        " 9.Receita Patrimonial - Não financeiras",
        "Informação Luiz sobre contrato BB",
        "S",
        paid_until(PAYROLL_LAST_YEAR, 12 * (PAYROLL_CONTRACT / PAYROLL_CONTRACT_MONTHS)),
    ),
    ManualRow(
        "520091", "62121000000", "19", "0299000000", "1990992101",
        "Acréscimos Contratuais PRODEC",
        "24. OUTRAS RECEITAS CORRENTES",
        "Informações do FADESC sobre arrecadação para 2020",
        "N",
        grown_from(PRODEC_FIRST_YEAR, PRODEC_FIRST_AMOUNT, "IPCA"),
    ),
    ManualRow(
        "520099", "62121000000", "21", "0191000000", "2119001100",
        "Espaço Fiscal",
        "Operações de crédito",
        "Informações da GEDIP sobre espaço fiscal do Estado",
        "N",
        indicated("INGRESSO_INTERNO"),
    ),
    ManualRow(
        "520099", "62121000000", "21", "0192000000", "2128015100",
        "BID/CAF/PROFISCO...",
        "Operações de crédito",
        "Informações da GEDIP",
        "N",
        indicated("INGRESSO_EXTERNO"),
    ),
)


def manual_rows(
    spark: SparkSession, parameters: Parameters, horizon: Horizon, rows: Sequence[ManualRow] = MANUAL_ROWS
) -> DataFrame:
    """Manual rows in the schema of the stacked slices."""
    stacked = [
        (
            row.unit, row.account, row.origin, row.fund, row.nature, row.name, horizon.base_year, 0.0, 0.0,
            row.label, row.memo, *[float(row.amount(parameters, year)) for year in horizon.years], row.ldo,
        )
        for row in rows
    ]
    return literal_table(spark, stacked, stacked_schema(horizon))


def stacked_schema(horizon: Horizon) -> T.StructType:
    def type_of(name: str) -> T.DataType:
        if name == YEAR:
            return T.IntegerType()
        if name in KEYS or name in (LABEL, MEMO, LDO):
            return T.StringType()
        return T.DoubleType()

    return T.StructType([T.StructField(name, type_of(name)) for name in stacked_columns(horizon)])
