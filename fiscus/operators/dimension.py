"""Rules as data: text conditions are looked at once per distinct name, fund, origin and account.

The rules are one array literal, whatever their number, so the plan and its compiled code do not grow with them.
It is tested on the distinct combinations of the text columns only; what a combination matches is joined back to the
reduced rows, where months and years decide. For a catalogue of dozens of rules the chain of conditions in ``aggregate``
is as good; this way takes thousands.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiscus.operators.aggregate import MAXIMA, SLICE, SUMS, reduce_fact
from fiscus.plans.rule import Rule
from fiscus.schema import ACCOUNT, FUND, KEYS, MONTH, NAME, ORIGIN, YEAR, Horizon
from fiscus.shared import stored

TEXT_KEYS = [ORIGIN, NAME, FUND, ACCOUNT]
RULE_SCHEMA = (
    "array<struct<slice_id:string,origin:string,name_any:array<string>,name_none:array<string>,fund_any:array<string>,"
    "fund_not_prefix:array<string>,account_none:array<string>,months:array<int>,years:array<int>>>"
)
PERIOD = "array<struct<slice_id:string,months:array<int>,years:array<int>>>"


def rules_literal(rules: Sequence[Rule], horizon: Horizon) -> Column:
    """All rules as one constant; bounds of months and years are pairs that may hold nulls."""
    rows = [
        {
            "slice_id": r.slice_id, "origin": r.origin, "name_any": r.name_any, "name_none": r.name_none, "fund_any": r.fund_any,
            "fund_not_prefix": r.fund_not_prefix, "account_none": r.account_none, "months": r.months,
            "years": [None if y is None else horizon.base_year + y for y in r.years],
        }
        for r in rules
    ]
    return F.from_json(F.lit(json.dumps(rows)), RULE_SCHEMA)


def _text_matches(rule: Column) -> Column:
    """Whether a rule takes the text columns of a row; unknown texts fail every condition on them, as in the rule's own condition."""

    def holds_any(column: str, words: Column) -> Column:
        return F.exists(words, lambda word: F.contains(F.col(column), word))

    def starts_any(column: str, words: Column) -> Column:
        return F.exists(words, lambda word: F.startswith(F.col(column), word))

    def unless_empty(words: Column, condition: Column) -> Column:
        return (F.size(words) == 0) | F.coalesce(condition, F.lit(False))

    return (
        (F.col(ORIGIN) == rule["origin"])
        & unless_empty(rule["name_any"], holds_any(NAME, rule["name_any"]))
        & unless_empty(rule["name_none"], ~holds_any(NAME, rule["name_none"]))
        & unless_empty(rule["fund_any"], holds_any(FUND, rule["fund_any"]))
        & unless_empty(rule["fund_not_prefix"], ~starts_any(FUND, rule["fund_not_prefix"]))
        & unless_empty(rule["account_none"], ~holds_any(ACCOUNT, rule["account_none"]))
    )


def _within(column: str, bounds: Column) -> Column:
    """Whether a number lies within bounds; open bounds take every number, and unknown ones only if both are open."""
    low, high = bounds[0], bounds[1]
    return (low.isNull() | F.coalesce(F.col(column) >= low, F.lit(False))) & (
        high.isNull() | F.coalesce(F.col(column) <= high, F.lit(False))
    )


def rules_by_text(rows: DataFrame, rules: Sequence[Rule], horizon: Horizon) -> DataFrame:
    """``TEXT_KEYS`` and ``taken``, the rules that take them, for every distinct combination that a rule takes."""
    taken = F.transform(
        F.filter(rules_literal(rules, horizon), _text_matches),
        lambda r: F.struct(r["slice_id"].alias("slice_id"), r["months"].alias("months"), r["years"].alias("years")),
    )
    return rows.select(*TEXT_KEYS).distinct().select(*TEXT_KEYS, taken.alias("taken")).filter(F.size("taken") > 0)


def aggregate_slices_by_text(fact: DataFrame, rules: Sequence[Rule], horizon: Horizon) -> DataFrame:
    """The same rows as ``aggregate_slices``. The reduced rows are stored, as both the look-up and the join read them."""
    reduced = stored(reduce_fact(fact, rules, horizon), "reduced-fact")
    texts = stored(rules_by_text(reduced, rules, horizon), "rules-by-text")
    named = texts.select(*[F.col(name).alias(f"text_{name}") for name in TEXT_KEYS], "taken")
    same = [F.col(name).eqNullSafe(F.col(f"text_{name}")) for name in TEXT_KEYS]
    in_time = F.filter("taken", lambda r: _within(MONTH, r["months"]) & _within(YEAR, r["years"]))
    return (
        reduced.join(named, same)
        .withColumn(SLICE, F.explode(F.transform(in_time, lambda r: r["slice_id"])))
        .groupBy(SLICE, *KEYS)
        .agg(
            *[F.sum(name).alias(name) for name in SUMS],
            *[F.max(name).alias(name) for name in MAXIMA],
        )
    )
