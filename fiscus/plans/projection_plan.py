"""From the fact table to the consolidated result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscus.operators.adjust import consolidate_fund, deflate, derive_codes, relabel_year
from fiscus.operators.aggregate import aggregate_slice, aggregate_slices
from fiscus.operators.flags import flag_rcl, flag_rli
from fiscus.operators.projection import project_slice, project_slices
from fiscus.plans.catalogue import CATALOGUE
from fiscus.plans.rule import Rule
from fiscus.schema import BASE_VALUE, NET_COLLECTED, UPDATED_AT, Horizon, result_columns
from fiscus.sources.manual import MANUAL_ROWS, ManualRow, manual_rows
from fiscus.sources.parameters import Parameters

DEFAULT_HORIZON = Horizon()


def category_slice(
    fact: DataFrame,
    rule: Rule,
    parameters: Parameters | None = None,
    horizon: Horizon = DEFAULT_HORIZON,
) -> DataFrame:
    """One labelled and projected category slice."""
    parameters = parameters or Parameters.default()
    return project_slice(aggregate_slice(fact, rule, horizon), rule, parameters, horizon)


def stacked_slices(
    fact: DataFrame,
    parameters: Parameters | None = None,
    horizon: Horizon = DEFAULT_HORIZON,
    rules: Sequence[Rule] = CATALOGUE,
) -> DataFrame:
    """All category slices stacked, from one scan of the fact table.

    An actual slice and its budget slice keep separate rows even where their
    keys agree; nothing is grouped again after this point.
    """
    parameters = parameters or Parameters.default()
    return project_slices(aggregate_slices(fact, rules, horizon), rules, parameters, horizon)


def stacked_with_manual_rows(
    fact: DataFrame,
    parameters: Parameters | None = None,
    horizon: Horizon = DEFAULT_HORIZON,
    rules: Sequence[Rule] = CATALOGUE,
    manual: Sequence[ManualRow] = MANUAL_ROWS,
) -> DataFrame:
    parameters = parameters or Parameters.default()
    slices = stacked_slices(fact, parameters, horizon, rules)
    return slices.unionByName(manual_rows(fact.sparkSession, parameters, horizon, manual))


def consolidate(
    stacked: DataFrame, parameters: Parameters | None = None, horizon: Horizon = DEFAULT_HORIZON
) -> DataFrame:
    """Year, flags, fund codes and constant prices; narrow work, no shuffle."""
    parameters = parameters or Parameters.default()
    flagged = flag_rli(flag_rcl(relabel_year(stacked, horizon)))
    coded = derive_codes(consolidate_fund(flagged.withColumnRenamed(NET_COLLECTED, BASE_VALUE)))
    return deflate(coded, parameters, horizon).select(*result_columns(horizon))


def project_revenue(
    fact: DataFrame,
    parameters: Parameters | None = None,
    horizon: Horizon = DEFAULT_HORIZON,
    rules: Sequence[Rule] = CATALOGUE,
    manual: Sequence[ManualRow] = MANUAL_ROWS,
) -> DataFrame:
    """The consolidated revenue projection, without the audit column; ``manual=()`` leaves contracts out."""
    return consolidate(stacked_with_manual_rows(fact, parameters, horizon, rules, manual), parameters, horizon)


def publishable_revenue(result: DataFrame) -> DataFrame:
    """Add the time of the run as text."""
    return result.withColumn(UPDATED_AT, F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"))
