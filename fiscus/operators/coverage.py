"""Which slices take which entries: overlaps, gaps, and a reconciliation of accounts with slices.

Slices overlap by design, and some entries of the revenue accounts belong to none. Every reduced row gets the set of
its slices as a bitmap; grouping by bitmap tells how many entries and which amounts each set holds, the
empty one included. The text conditions are looked at once per reduced row, never per entry.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiscus.operators.aggregate import SUMS, month_class
from fiscus.operators.filters import revenue_accounts
from fiscus.plans.rule import Rule
from fiscus.schema import KEYS, MONTH, NET_BUDGET, NET_COLLECTED, Horizon

BITS = 63  # of one bitmap word
SLICES, ENTRIES, TIMES = "slices", "entries", "times"


def slice_words(rules: Sequence[Rule], horizon: Horizon) -> list[Column]:
    """Bitmap words of a row: bit n of word w is rule 63 w + n; conditions that are unknown count as not met."""
    words = []
    for first in range(0, len(rules), BITS):
        bits = [f"CASE WHEN {rule.condition(horizon)} THEN {1 << n}L ELSE 0L END" for n, rule in enumerate(rules[first : first + BITS])]
        words.append(F.expr(" | ".join(bits)))
    return words


def slice_coverage(fact: DataFrame, rules: Sequence[Rule], horizon: Horizon) -> DataFrame:
    """One row per set of slices: their identifiers, how many, and the entries and net amounts of the rows they share.

    All entries of the revenue accounts are in exactly one set.
    """
    reduced = (
        revenue_accounts(fact)
        .groupBy(*KEYS, month_class(rules).alias(MONTH))
        .agg(F.count(F.lit(1)).alias(ENTRIES), *[F.sum(column).alias(name) for name, column in SUMS.items()])
    )
    words = slice_words(rules, horizon)
    names = [f"word{n}" for n in range(len(words))]
    gross, taken, planned, planned_taken = (F.sum(name) for name in SUMS)
    sets = (
        reduced.select(ENTRIES, *SUMS, *[word.alias(name) for word, name in zip(words, names)])
        .groupBy(*names)
        .agg(
            F.sum(ENTRIES).alias(ENTRIES),
            (gross - taken).alias(NET_COLLECTED),
            (planned - planned_taken).alias(NET_BUDGET),
        )
    )
    return sets.select(
        _identifiers(rules, names).alias(SLICES),
        reduce(lambda a, b: a + b, [F.bit_count(name) for name in names]).cast("int").alias(TIMES),
        ENTRIES,
        NET_COLLECTED,
        NET_BUDGET,
    )


def _identifiers(rules: Sequence[Rule], names: Sequence[str]) -> Column:
    """Identifiers of the bits that are set, in rule order, joined by ``+``; empty for the empty set."""
    marks = [
        F.when(F.col(names[n // BITS]).bitwiseAND(F.lit(1 << (n % BITS))) != 0, F.lit(rule.slice_id)) for n, rule in enumerate(rules)
    ]
    return F.array_join(F.array_compact(F.array(*marks)), "+")


def reconciliation(coverage: DataFrame) -> DataFrame:
    """Accounts = slices - repeated + uncovered, in entries and amounts, with the difference as the last line.

    ``slices`` counts an entry once for each slice that takes it, ``repeated`` for each but the first,
    ``uncovered`` holds entries that no slice takes. From the few sets of the coverage; not from the fact.
    """
    lines = {
        "accounts": F.lit(1),
        "slices": F.col(TIMES),
        "repeated": F.greatest(F.col(TIMES) - 1, F.lit(0)),
        "uncovered": F.when(F.col(TIMES) == 0, 1).otherwise(0),
    }
    lines["difference"] = lines["accounts"] - lines["slices"] + lines["repeated"] - lines["uncovered"]
    weighed = coverage.select(
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("ord"), F.lit(name).alias("line"), times.cast("int").alias("n"))
                      for n, (name, times) in enumerate(lines.items(), 1)])
        ).alias("of"),
        ENTRIES, NET_COLLECTED, NET_BUDGET,
    )
    return weighed.groupBy("of.ord", "of.line").agg(
        F.sum(F.col("of.n") * F.col(ENTRIES)).alias(ENTRIES),
        F.sum(F.col("of.n") * F.col(NET_COLLECTED)).cast("double").alias(NET_COLLECTED),
        F.sum(F.col("of.n") * F.col(NET_BUDGET)).cast("double").alias(NET_BUDGET),
    )
