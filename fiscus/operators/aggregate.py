"""Net aggregation of the fact table, for one slice or for all in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiscus.functions.predicates import all_of, text_literal
from fiscus.operators.filters import revenue_accounts
from fiscus.plans.rule import MAX, NONE, SUM, Rule
from fiscus.schema import (
    BUDGETED, BUDGETED_DEDUCTION, COLLECTED, COLLECTED_DEDUCTION, KEYS, MONTH,
    NET_BUDGET, NET_COLLECTED, ORIGIN, YEAR, Horizon,
)

SLICE = "slice_id"

# Names of the partial results between the two aggregation steps.
SUMS = {
    "sum_collected": COLLECTED,
    "sum_collected_deduction": COLLECTED_DEDUCTION,
    "sum_budgeted": BUDGETED,
    "sum_budgeted_deduction": BUDGETED_DEDUCTION,
}
MAXIMA = {"max_collected": COLLECTED, "max_collected_deduction": COLLECTED_DEDUCTION}


def net_sum(gross: str, deduction: str) -> Column:
    """Sum minus sum of deductions, exact in decimals; NULL if either side is all NULL."""
    return (F.sum(gross) - F.sum(deduction)).cast("double")


def net_max(gross: str, deduction: str) -> Column:
    return (F.max(gross) - F.max(deduction)).cast("double")


def aggregate_slice(fact: DataFrame, rule: Rule, horizon: Horizon) -> DataFrame:
    """Group one category slice by the seven keys; every filter can reach the scan."""
    collected = {
        SUM: net_sum(COLLECTED, COLLECTED_DEDUCTION),
        MAX: net_max(COLLECTED, COLLECTED_DEDUCTION),
        NONE: F.lit(0.0),
    }[rule.collected]
    budget = F.lit(0.0) if rule.budget == NONE else net_sum(BUDGETED, BUDGETED_DEDUCTION)
    return (
        revenue_accounts(fact)
        .filter(rule.condition(horizon))
        .groupBy(*KEYS)
        .agg(collected.alias(NET_COLLECTED), budget.alias(NET_BUDGET))
        .withColumn(NET_COLLECTED, annualised(F.col(NET_COLLECTED), rule.collected_months, rule.collected_times))
    )


def annualised(amount: Column, months: Column | int, times: Column | int) -> Column:
    """Monthly mean of a partial year, times a number of months; ones change nothing."""
    return amount / months * times


def month_class(rules: Sequence[Rule]) -> Column:
    """A representative month for all months that no rule of the origin tells apart.

    Months between two window edges fall into one class, named by its first
    month, so that every month condition holds for the class exactly when it
    holds for each month in it. Origins without month windows need no class.
    """
    edges: dict[str, set[int]] = {}
    for rule in rules:
        if rule.has_month_bound:
            first, last = rule.months
            found = edges.setdefault(rule.origin, set())
            found.update([first] if first is not None else [])
            found.update([last + 1] if last is not None else [])
    branches = [
        f"WHEN {ORIGIN} = {text_literal(origin)} THEN {_class_between(sorted(found))}"
        for origin, found in edges.items()
    ]
    return F.expr(f"CASE {' '.join(branches)} END") if branches else F.lit(None).cast("int")


def _class_between(edges: Sequence[int]) -> str:
    later = [f"WHEN {MONTH} >= {edge} THEN {edge}" for edge in reversed(edges)]
    return f"CASE {' '.join(later)} WHEN {MONTH} < {edges[0]} THEN {edges[0] - 1} END"


def bounded_origins(rules: Sequence[Rule], horizon: Horizon) -> str | None:
    """Months and years that some rule takes, for each origin whose rules are all bounded; it reaches the scan."""
    by_origin: dict[str, list[str]] = {}
    for rule in rules:
        by_origin.setdefault(rule.origin, []).append(all_of(rule.period(horizon)) if rule.period(horizon) else "")
    parts = [
        f"({ORIGIN} <> {text_literal(origin)} OR {' OR '.join(f'({bound})' for bound in dict.fromkeys(bounds))})"
        for origin, bounds in by_origin.items()
        if all(bounds)
    ]
    return all_of(parts) if parts else None


def reduce_fact(fact: DataFrame, rules: Sequence[Rule], horizon: Horizon) -> DataFrame:
    """First step: collapse the fact table to one row per key and month class.

    This is the only step whose work grows with the fact table. It reads the
    table once, evaluates no text search but the account filter, and combines
    on the map side, so a key that holds a large share of all rows sends at
    most one row per task and month class through the shuffle. Months and
    years that no rule of an origin takes are left at the scan.
    """
    origins = sorted({rule.origin for rule in rules})
    bounds = bounded_origins(rules, horizon)
    taken = revenue_accounts(fact).filter(F.col(ORIGIN).isin(origins))
    return (
        (taken.filter(bounds) if bounds else taken)
        .groupBy(*KEYS, month_class(rules).alias(MONTH))
        .agg(
            *[F.sum(column).alias(name) for name, column in SUMS.items()],
            *[F.max(column).alias(name) for name, column in MAXIMA.items()],
        )
    )


def matching_slices(rules: Sequence[Rule], horizon: Horizon) -> Column:
    """Identifiers of all slices that take a row; categories may overlap."""
    marks = [
        f"CASE WHEN {rule.condition(horizon)} THEN {text_literal(rule.slice_id)} END" for rule in rules
    ]
    return F.expr(f"array_compact(array({', '.join(marks)}))")


def aggregate_slices(fact: DataFrame, rules: Sequence[Rule], horizon: Horizon) -> DataFrame:
    """All slices from one scan: reduce, assign slices, merge month classes."""
    return merged_slices(reduce_fact(fact, rules, horizon), rules, horizon)


def merged_slices(reduced: DataFrame, rules: Sequence[Rule], horizon: Horizon) -> DataFrame:
    """Slices of rows that are reduced by key and month, or by key and month class."""
    return (
        reduced.withColumn(SLICE, F.explode(matching_slices(rules, horizon)))
        .groupBy(SLICE, *KEYS)
        .agg(
            *[F.sum(name).alias(name) for name in SUMS],
            *[F.max(name).alias(name) for name in MAXIMA],
        )
    )


def yearly_collection(fact: DataFrame, *extra_keys: str) -> DataFrame:
    """Net collection of all revenue accounts by year and optional further keys."""
    return (
        revenue_accounts(fact)
        .groupBy(YEAR, *extra_keys)
        .agg(net_sum(COLLECTED, COLLECTED_DEDUCTION).alias(NET_COLLECTED))
    )
