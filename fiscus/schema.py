"""Column names and types of the fact table and of the consolidated result."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

UNIT = "cod_unidade_gestora"
ACCOUNT = "cod_conta_contabil"
ORIGIN = "cod_origem"
FUND = "cod_fonte_recurso"
NATURE = "cod_detalhamento"
NAME = "nom_detalhamento"
YEAR = "num_ano"
MONTH = "num_mes"

COLLECTED = "val_receita_arrecadada"
COLLECTED_DEDUCTION = "val_receita_arrecadada_deducao"
BUDGETED = "val_receita_orcada"
BUDGETED_DEDUCTION = "val_receita_orcada_deducao"

KEYS = [UNIT, ACCOUNT, ORIGIN, FUND, NATURE, NAME, YEAR]
MEASURES = [COLLECTED, COLLECTED_DEDUCTION, BUDGETED, BUDGETED_DEDUCTION]

CODES = KEYS[:-1]

MONEY = T.DecimalType(18, 2)
# Amounts that do not come as decimals: text, doubles, integers.
AMOUNT = T.DecimalType(28, 8)

FACT_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in KEYS[:-1]]
    + [T.StructField(YEAR, T.IntegerType()), T.StructField(MONTH, T.IntegerType())]
    + [T.StructField(name, MONEY) for name in MEASURES]
)

# Columns that the projection adds to the keys.
NET_COLLECTED = "receita_arrecadada_liquida"
NET_BUDGET = "receita_orcada_liquida"
BASE_VALUE = "valor_base"
LABEL = "nome_receita_ldo"
MEMO = "memoria_calculo"
LDO = "ldo"
RCL = "rcl"
RLI = "RLI"
SHORT_FUND = "cod_fonte_reduzida"
FUND_TYPE = "cod_tipo_fr"
UPDATED_AT = "DataAtualizacao"


@dataclass(frozen=True)
class Horizon:
    """Base year of the actuals and last projected year."""

    base_year: int = 2019
    last_year: int = 2023

    def __post_init__(self) -> None:
        if self.last_year <= self.base_year:
            raise ValueError("last_year must come after base_year")

    @property
    def first_year(self) -> int:
        return self.base_year + 1

    @property
    def years(self) -> list[int]:
        return list(range(self.first_year, self.last_year + 1))

    @property
    def projections(self) -> list[str]:
        return [projection(year) for year in self.years]

    @property
    def deflated(self) -> list[str]:
        return [f"projecao{year}aValoresDe{self.base_year}" for year in self.years]


def projection(year: int) -> str:
    return f"projecao_receita_arrecadada_liquida{year}"


def stacked_columns(horizon: Horizon) -> list[str]:
    """Columns of the stacked slices, before flags and deflation."""
    return [*KEYS, NET_COLLECTED, NET_BUDGET, LABEL, MEMO, *horizon.projections, LDO]


def result_columns(horizon: Horizon) -> list[str]:
    """Columns of the consolidated table, without the audit column."""
    return [
        *KEYS, BASE_VALUE, NET_BUDGET, LABEL, MEMO, *horizon.projections,
        LDO, RCL, RLI, SHORT_FUND, FUND_TYPE, *horizon.deflated,
    ]
