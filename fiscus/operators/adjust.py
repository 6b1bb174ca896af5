"""Adjustments of the stacked slices: year, fund codes, constant prices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiscus.schema import (
    ACCOUNT, FUND, FUND_TYPE, NET_BUDGET, SHORT_FUND, YEAR, Horizon, projection,
)
from fiscus.sources.parameters import Parameters

# Account prefix of collected revenue, and funds that are
# reported as the ordinary treasury fund.
COLLECTION_PREFIX = "621"
CONSOLIDATED_FUNDS = {"0161000000": "0100000000", "0162000000": "0100000000"}


def relabel_year(df: DataFrame, horizon: Horizon) -> DataFrame:
    """Collected revenue of any year counts for the first projected year.

    Seeds look at the original year, so this comes after the projection.
    """
    relabelled = F.when(F.col(ACCOUNT).startswith(COLLECTION_PREFIX), F.lit(horizon.first_year))
    return df.withColumn(YEAR, relabelled.otherwise(F.col(YEAR)))


def consolidate_fund(df: DataFrame) -> DataFrame:
    return df.replace(CONSOLIDATED_FUNDS, subset=[FUND])


def derive_codes(df: DataFrame) -> DataFrame:
    """Short fund code and fund type, both cut from the consolidated fund."""
    return df.withColumns(
        {SHORT_FUND: F.left(F.col(FUND), F.lit(4)), FUND_TYPE: F.substring(FUND, 3, 2)}
    )


def deflate(df: DataFrame, parameters: Parameters, horizon: Horizon) -> DataFrame:
    """Amounts at base-year prices: the budget for the first year, projections after it."""
    return deflators_of(df, [F.lit(parameters.deflator(horizon.base_year, year)) for year in horizon.years], horizon)


def deflators_of(df: DataFrame, deflators: Sequence[Column], horizon: Horizon) -> DataFrame:
    """The same with one deflator per projected year."""
    nominal = [NET_BUDGET, *[projection(year) for year in horizon.years[1:]]]
    return df.withColumns(
        {
            name: F.col(source) / deflator
            for name, source, deflator in zip(horizon.deflated, nominal, deflators)
        }
    )
