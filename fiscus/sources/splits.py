"""Balanced splits of a database read: bins of months with about as many rows each.

The database counts its rows by year and month, one small result. Months are dealt to bins, the largest first, each
to the bin that has least so far. Every bin is one condition and one read task; one more condition takes whatever the count
did not see, months that arrived since and rows without year or month, so no row is read twice and none is left out.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from fiscus.schema import MONTH, YEAR
from fiscus.sources.fact import SPLIT_OPTIONS, read_fact_jdbc

Month = tuple[int, int]


def balanced_bins(rows: Mapping[Month, int], bins: int) -> list[list[Month]]:
    """At most ``bins`` lists of months; no bin has more rows than the smallest other one and one month together."""
    if bins < 1:
        raise ValueError("at least one bin is needed")
    heap = [(0, n) for n in range(min(bins, len(rows)))]
    dealt: list[list[Month]] = [[] for _ in heap]
    for month, count in sorted(rows.items(), key=lambda item: (-item[1], item[0])):
        size, n = heapq.heappop(heap)
        dealt[n].append(month)
        heapq.heappush(heap, (size + count, n))
    return [sorted(months) for months in dealt]


def _takes(months: Sequence[Month]) -> str:
    by_year: dict[int, list[int]] = {}
    for year, month in months:
        by_year.setdefault(year, []).append(month)
    parts = [f"({YEAR} = {year} AND {MONTH} IN ({', '.join(map(str, found))}))" for year, found in sorted(by_year.items())]
    return "(" + " OR ".join(parts) + ")"


def split_conditions(bins: Sequence[Sequence[Month]]) -> list[str]:
    """One WHERE condition per bin and one for all other rows; every row meets exactly one."""
    if not bins:
        return ["1 = 1"]
    known = _takes([month for months in bins for month in months])
    return [*map(_takes, bins), f"({YEAR} IS NULL OR {MONTH} IS NULL OR NOT {known})"]


def month_counts(spark: SparkSession, options: Mapping[str, str]) -> dict[Month, int]:
    """Rows by year and month, counted by the database."""
    split = {name.lower() for name in SPLIT_OPTIONS}
    plain = {name.lower(): value for name, value in options.items() if name.lower() not in split}
    plain["dbtable"] = f"(SELECT {YEAR}, {MONTH}, count(*) AS n FROM {plain['dbtable']} GROUP BY {YEAR}, {MONTH}) q"
    found = spark.read.format("jdbc").options(**plain).load().collect()  # one row per month
    return {(int(y), int(m)): int(n) for y, m, n in found if y is not None and m is not None}


def read_fact_balanced(spark: SparkSession, options: Mapping[str, str], bins: int) -> DataFrame:
    """The fact in a database, read by ``bins`` tasks of about the same size and one for what came in between."""
    conditions = split_conditions(balanced_bins(month_counts(spark, options), bins))
    plain = {name.lower(): value for name, value in options.items()}
    return read_fact_jdbc(spark, plain, predicates=conditions)
