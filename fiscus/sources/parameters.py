"""Macro-economic and debt parameters, and the values derived from them."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fiscus.sources.local import literal_table

# Indicator, then year and value. Growth indicators are factors,
# SELIC is a rate, debt inflows and nominal GDP are amounts.
PUBLISHED_VALUES = {
    "IPCA": {2020: 1.0305, 2021: 1.0357, 2022: 1.035, 2023: 1.035},
    "PIB": {2020: 1.0002, 2021: 1.025, 2022: 1.025, 2023: 1.025},
    "EF": {2020: 1.0, 2021: 1.0, 2022: 1.0, 2023: 1.0},
    "CVFS": {2020: 1.05, 2021: 1.05, 2022: 1.05, 2023: 1.05},
    "ANFAVEA": {2020: 0.97},
    "SELIC": {2019: 0.065, 2020: 0.0375, 2021: 0.0525, 2022: 0.06, 2023: 0.0625},
    "FX": {2019: 4.1, 2020: 4.5, 2021: 4.29, 2022: 4.23, 2023: 4.3},
    "COVID_EMPREGO": {2020: 1.0, 2021: 1.0, 2022: 1.0, 2023: 1.0},
    "INGRESSO_EXTERNO": {2020: 37695571.0, 2021: 0.0, 2022: 0.0, 2023: 0.0},
    "INGRESSO_INTERNO": {2020: 262799084.0, 2021: 512000000.0, 2022: 550000000.0, 2023: 0.0},
    "PIB_SC": {2017: 275400000000.0, 2018: 298381000000.0, 2019: 317300000000.0},
}

# Yearly loss of value of the vehicle fleet, and the year whose
# indices each fleet factor uses (2023 repeats the indices of 2022).
FLEET_DEPRECIATION = 0.97
FLEET_INDEX_YEAR = {2021: 2021, 2022: 2022, 2023: 2022}

INDEX_SCHEMA = T.StructType(
    [
        T.StructField("indicator", T.StringType()),
        T.StructField("ref_year", T.IntegerType()),
        T.StructField("value", T.DoubleType()),
    ]
)


@dataclass(frozen=True)
class Parameters:
    """Indicator values by year; override single values with ``replace``."""

    values: Mapping[tuple[str, int], float]

    @staticmethod
    def default() -> Parameters:
        return Parameters.of(PUBLISHED_VALUES)

    @staticmethod
    def of(table: Mapping[str, Mapping[int, float]]) -> Parameters:
        return Parameters(
            {(name, year): float(value) for name, years in table.items() for year, value in years.items()}
        )

    def replace(self, changes: Mapping[tuple[str, int], float]) -> Parameters:
        return Parameters({**self.values, **changes})

    def value(self, indicator: str, year: int) -> float:
        """A given value, else a derived one."""
        given = self.values.get((indicator, year))
        if given is not None:
            return given
        if indicator == "ANFAVEA":
            index_year = FLEET_INDEX_YEAR.get(year, year)
            return self.value("IPCA", index_year) * self.value("PIB", index_year) * FLEET_DEPRECIATION
        if indicator == "SELIC_RATIO":
            return self.value("SELIC", year) / self.value("SELIC", year - 1)
        raise KeyError(f"no value for {indicator} in {year}")

    def deflator(self, base_year: int, year: int) -> float:
        """Cumulative inflation from the base year, multiplied year by year."""
        cumulative = self.value("IPCA", base_year + 1)
        for step in range(base_year + 2, year + 1):
            cumulative = cumulative * self.value("IPCA", step)
        return cumulative


def macro_index(spark: SparkSession, parameters: Parameters) -> DataFrame:
    """All indicators as rows; fleet factors that are not given are derived for every year that has both indices."""
    given = parameters.values
    rows = [(name, year, value) for (name, year), value in given.items()]

    def indexed(year: int) -> bool:
        return ("IPCA", year) in given and ("PIB", year) in given

    rows += [
        ("ANFAVEA", year, parameters.value("ANFAVEA", year))
        for year in sorted({year for _, year in given})
        if ("ANFAVEA", year) not in given and indexed(year) and indexed(FLEET_INDEX_YEAR.get(year, year))
    ]
    return literal_table(spark, rows, INDEX_SCHEMA)


def nominal_gdp(indices: DataFrame) -> DataFrame:
    """Nominal GDP by year: given years as they are, later ones chained by real growth and inflation."""
    gdp = (
        indices.filter(F.col("indicator").isin("PIB_SC", "PIB", "IPCA"))
        .groupBy("ref_year")
        .agg(
            F.max(F.when(F.col("indicator") == "PIB_SC", F.col("value"))).alias("given"),
            F.max(F.when(F.col("indicator") == "PIB", F.col("value"))).alias("growth"),
            F.max(F.when(F.col("indicator") == "IPCA", F.col("value"))).alias("inflation"),
        )
    )
    # The windows span one row per parameter year, not the fact table. A given value starts a new run.
    history = Window.orderBy("ref_year").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = Window.partitionBy("run").orderBy("ref_year").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.when(F.col("given").isNull(), F.col("growth") * F.col("inflation"))
    chained = F.first("given").over(run) * F.product(step).over(run)
    return gdp.withColumn("run", F.count("given").over(history)).select(
        "ref_year", F.coalesce("given", chained).alias("nominal_gdp")
    )


def selic_growth(indices: DataFrame) -> DataFrame:
    """Interest rate of each year relative to the year before."""
    by_year = Window.partitionBy("indicator").orderBy("ref_year")
    return (
        indices.filter(F.col("indicator") == "SELIC")
        .withColumn("previous", F.lag("value").over(by_year))
        .filter(F.col("previous").isNotNull())
        .select("ref_year", (F.col("value") / F.col("previous")).alias("selic_ratio"))
    )
