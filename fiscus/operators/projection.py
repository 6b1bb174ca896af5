"""Seed of the first projected year and compounding over the horizon."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import mul

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fiscus.operators.aggregate import SLICE, annualised
from fiscus.plans.rule import MAX, NONE, SUM, Rule, resolve
from fiscus.schema import (
    LABEL, LDO, MEMO, NET_BUDGET, NET_COLLECTED, YEAR, Horizon, projection, stacked_columns,
)
from fiscus.sources.local import literal_table
from fiscus.sources.parameters import Parameters


def times_each(amount: Column, factors: Sequence[Column | float]) -> Column:
    """Multiply from left to right; the order decides the last digit of a double."""
    return reduce(mul, factors, amount)


def seed_and_compound(
    df: DataFrame,
    horizon: Horizon,
    seed_year: Column | int,
    seed: Sequence[Column | float],
    growth: dict[int, Sequence[Column | float]],
) -> DataFrame:
    """Seed from rows of the seed year, all other rows start at zero, then compound."""
    seeded = F.when(F.col(YEAR) == seed_year, times_each(F.col(NET_COLLECTED), seed)).otherwise(F.lit(0.0))
    df = df.withColumn(projection(horizon.first_year), seeded)
    for year in horizon.years[1:]:
        df = df.withColumn(projection(year), times_each(F.col(projection(year - 1)), growth[year]))
    return df


def project_slice(aggregated: DataFrame, rule: Rule, parameters: Parameters, horizon: Horizon) -> DataFrame:
    """Label and project the groups of one slice with literal factors."""
    labelled = aggregated.withColumns(
        {LABEL: F.lit(rule.label), MEMO: F.lit(rule.memo), LDO: F.lit(rule.ldo)}
    )
    if rule.seed is None:
        projected = labelled.withColumns({name: F.lit(0.0) for name in horizon.projections})
    else:
        projected = seed_and_compound(
            labelled,
            horizon,
            horizon.base_year + rule.seed_year,
            resolve(rule.seed, parameters, horizon.first_year),
            {year: resolve(rule.growth, parameters, year) for year in horizon.years[1:]},
        )
    return projected.select(*stacked_columns(horizon))


def rule_table(
    spark: SparkSession, rules: Sequence[Rule], parameters: Parameters, horizon: Horizon
) -> DataFrame:
    """One row per rule: texts, measure choice and all factors as numbers.

    Shorter factor lists are filled up with one, which leaves a product
    exactly as it is.
    """
    seed_width, growth_width = _widths(rules)
    fields = [
        (SLICE, T.StringType()), (LABEL, T.StringType()), (MEMO, T.StringType()), (LDO, T.StringType()),
        ("collected", T.StringType()), ("budget", T.StringType()),
        ("collected_months", T.DoubleType()), ("collected_times", T.DoubleType()),
        ("seed_year", T.IntegerType()), ("projected", T.BooleanType()),
        *[(name, T.DoubleType()) for name in _factor_names("seed", seed_width)],
        *[
            (name, T.DoubleType())
            for year in horizon.years[1:]
            for name in _factor_names(f"growth{year}", growth_width)
        ],
    ]

    def filled(factors, year, width):
        values = [] if factors is None else resolve(factors, parameters, year)
        return values + [1.0] * (width - len(values))

    rows = [
        (
            rule.slice_id, rule.label, rule.memo, rule.ldo, rule.collected, rule.budget,
            float(rule.collected_months), float(rule.collected_times),
            horizon.base_year + rule.seed_year, rule.seed is not None,
            *filled(rule.seed, horizon.first_year, seed_width),
            *[value for year in horizon.years[1:] for value in filled(rule.growth, year, growth_width)],
        )
        for rule in rules
    ]
    return literal_table(spark, rows, T.StructType([T.StructField(*field) for field in fields]))


def project_slices(
    aggregated: DataFrame, rules: Sequence[Rule], parameters: Parameters, horizon: Horizon
) -> DataFrame:
    """Label and project the groups of all slices."""
    return project_by(rule_table(aggregated.sparkSession, rules, parameters, horizon), aggregated, rules, horizon)


def project_by(
    rows: DataFrame, aggregated: DataFrame, rules: Sequence[Rule], horizon: Horizon, also: Sequence[str] = ()
) -> DataFrame:
    """Label and project by a rule table; ``also`` names further columns of it that the result keeps.

    The rule table has one row per rule (and further argument of the caller's) and does not grow with the data, so it
    is safe to broadcast.
    """
    seed_width, growth_width = _widths(rules)
    joined = aggregated.join(F.broadcast(rows), SLICE)

    net_collected = (
        F.when(F.col("collected") == SUM, F.col("sum_collected") - F.col("sum_collected_deduction"))
        .when(F.col("collected") == MAX, F.col("max_collected") - F.col("max_collected_deduction"))
        .otherwise(F.lit(0))
        .cast("double")
    )
    net_budget = (
        F.when(F.col("budget") == NONE, F.lit(0))
        .otherwise(F.col("sum_budgeted") - F.col("sum_budgeted_deduction"))
        .cast("double")
    )
    measured = joined.withColumns(
        {
            NET_COLLECTED: annualised(net_collected, F.col("collected_months"), F.col("collected_times")),
            NET_BUDGET: net_budget,
        }
    )
    compounded = seed_and_compound(
        measured,
        horizon,
        F.when(F.col("projected"), F.col("seed_year")),
        [F.col(name) for name in _factor_names("seed", seed_width)],
        {
            year: [F.col(name) for name in _factor_names(f"growth{year}", growth_width)]
            for year in horizon.years[1:]
        },
    )
    return compounded.select(*also, *stacked_columns(horizon))


def _widths(rules: Sequence[Rule]) -> tuple[int, int]:
    return (
        max(len(rule.seed or ()) for rule in rules),
        max(len(rule.growth or ()) for rule in rules),
    )


def _factor_names(step: str, width: int) -> list[str]:
    return [f"{step}_factor{position}" for position in range(1, width + 1)]
