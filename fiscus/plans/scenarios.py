"""Several parameter sets in one pass over the fact table.

The fact is reduced and dealt to slices once; only then does every group meet the rule table of each scenario. The
work that grows with the fact table is that of one projection, whatever the number of scenarios.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fiscus.operators.adjust import consolidate_fund, deflators_of, derive_codes, relabel_year
from fiscus.operators.aggregate import aggregate_slices
from fiscus.operators.flags import flag_rcl, flag_rli
from fiscus.operators.projection import project_by, rule_table
from fiscus.plans.catalogue import CATALOGUE
from fiscus.plans.projection_plan import DEFAULT_HORIZON
from fiscus.plans.rule import Rule
from fiscus.schema import BASE_VALUE, NET_COLLECTED, Horizon, result_columns
from fiscus.sources.local import literal_table
from fiscus.sources.manual import MANUAL_ROWS, ManualRow, manual_rows
from fiscus.sources.parameters import Parameters

SCENARIO = "cenario"


def project_scenarios(
    fact: DataFrame,
    scenarios: Mapping[str, Parameters],
    horizon: Horizon = DEFAULT_HORIZON,
    rules: Sequence[Rule] = CATALOGUE,
    manual: Sequence[ManualRow] = MANUAL_ROWS,
) -> DataFrame:
    """The consolidated projection of every scenario, named in the first column; one scan of the fact table."""
    if not scenarios:
        raise ValueError("at least one scenario is needed")
    spark = fact.sparkSession

    def named(name: str, rows: DataFrame) -> DataFrame:
        return rows.select(F.lit(name).alias(SCENARIO), "*")

    def stacked(frames) -> DataFrame:
        return reduce(DataFrame.unionByName, frames)

    tables = stacked(named(name, rule_table(spark, rules, given, horizon)) for name, given in scenarios.items())
    slices = project_by(tables, aggregate_slices(fact, rules, horizon), rules, horizon, also=[SCENARIO])
    contracts = stacked(named(name, manual_rows(spark, given, horizon, manual)) for name, given in scenarios.items())
    flagged = flag_rli(flag_rcl(relabel_year(slices.unionByName(contracts), horizon)))
    coded = derive_codes(consolidate_fund(flagged.withColumnRenamed(NET_COLLECTED, BASE_VALUE)))
    return deflate_scenarios(coded, scenarios, horizon).select(SCENARIO, *result_columns(horizon))


def deflate_scenarios(df: DataFrame, scenarios: Mapping[str, Parameters], horizon: Horizon) -> DataFrame:
    """Amounts at base-year prices, by the inflation of each row's scenario."""
    years = [f"deflator{year}" for year in horizon.years]
    schema = T.StructType([T.StructField(SCENARIO, T.StringType())] + [T.StructField(name, T.DoubleType()) for name in years])
    rows = [
        (name, *(given.deflator(horizon.base_year, year) for year in horizon.years)) for name, given in scenarios.items()
    ]
    # One row per scenario, as given by the caller.
    joined = df.join(F.broadcast(literal_table(df.sparkSession, rows, schema)), SCENARIO)
    return deflators_of(joined, [F.col(name) for name in years], horizon)
