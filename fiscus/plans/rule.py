"""A category rule: which fact rows it takes and how it projects them."""

from __future__ import annotations

from dataclasses import dataclass

from fiscus.functions.predicates import (
    all_of, contains_any, contains_none, starts_with_none, text_literal,
)
from fiscus.schema import ACCOUNT, FUND, MONTH, NAME, ORIGIN, YEAR, Horizon
from fiscus.sources.parameters import Parameters

# A factor is an indicator name, a number, or an indicator with an offset.
Factor = str | float | tuple[str, float]

SUM, MAX, NONE = "sum", "max", "none"


@dataclass(frozen=True)
class Rule:
    """One slice of the fact table and its projection.

    Months are inclusive bounds; years are inclusive offsets from the base
    year; ``None`` leaves a bound open. ``seed`` and ``growth`` are factors
    applied left to right, ``None`` means that the projection is zero.
    """

    slice_id: str
    label: str
    memo: str
    ldo: str
    origin: str
    seed: tuple[Factor, ...] | None
    growth: tuple[Factor, ...] | None
    name_any: tuple[str, ...] = ()
    name_none: tuple[str, ...] = ()
    fund_any: tuple[str, ...] = ()
    fund_not_prefix: tuple[str, ...] = ()
    account_none: tuple[str, ...] = ()
    months: tuple[int | None, int | None] = (None, None)
    years: tuple[int | None, int | None] = (None, None)
    collected: str = SUM
    budget: str = SUM
    collected_months: int = 1
    collected_times: int = 1
    seed_year: int = 0

    @property
    def has_month_bound(self) -> bool:
        return self.months != (None, None)

    def condition(self, horizon: Horizon) -> str:
        """The rule's own condition; the account filter common to all rules comes on top."""
        parts = [f"{ORIGIN} = {text_literal(self.origin)}"]
        if self.name_any:
            parts.append(contains_any(NAME, self.name_any))
        if self.name_none:
            parts.append(contains_none(NAME, self.name_none))
        if self.fund_any:
            parts.append(contains_any(FUND, self.fund_any))
        if self.fund_not_prefix:
            parts.append(starts_with_none(FUND, self.fund_not_prefix))
        if self.account_none:
            parts.append(contains_none(ACCOUNT, self.account_none))
        return all_of(parts + self.period(horizon))

    def period(self, horizon: Horizon) -> list[str]:
        """The rule's month and year conditions; none if it takes any time."""
        years = [None if y is None else horizon.base_year + y for y in self.years]
        return _between(MONTH, *self.months) + _between(YEAR, *years)


def _between(name: str, low: int | None, high: int | None) -> list[str]:
    bounds = []
    if low is not None:
        bounds.append(f"{name} >= {low}")
    if high is not None:
        bounds.append(f"{name} <= {high}")
    return bounds


def resolve(factors: tuple[Factor, ...], parameters: Parameters, year: int) -> list[float]:
    """Factor values of one year, in order."""
    values = []
    for factor in factors:
        if isinstance(factor, str):
            values.append(parameters.value(factor, year))
        elif isinstance(factor, tuple):
            indicator, offset = factor
            values.append(parameters.value(indicator, year) + offset)
        else:
            values.append(float(factor))
    return values
