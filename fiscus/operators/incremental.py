"""Net aggregates kept up to date by month: new months are added, restated ones replaced.

A month is reduced once to partial results per key: sums, maxima and the number of entries. They are stored in folders
by load, year and month. A log says which load counts for a month, so a restated month takes the place of the old one in
one step, maxima included, and what a load that breaks has written never counts. Net aggregates and all slices merge
partial results; entries of months that did not change are never read again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fiscus.operators.aggregate import MAXIMA, SUMS, merged_slices
from fiscus.operators.filters import revenue_accounts
from fiscus.plans.rule import Rule
from fiscus.schema import KEYS, MONTH, NET_BUDGET, NET_COLLECTED, ORIGIN, YEAR, Horizon
from fiscus.sinks.manifest import Manifest

ENTRIES = "entries"
LOAD = "load"
Month = tuple[int, int]

LOG_SCHEMA = T.StructType(
    [
        T.StructField("number", T.LongType()),
        T.StructField(LOAD, T.StringType()),
        T.StructField(YEAR, T.IntegerType()),
        T.StructField(MONTH, T.IntegerType()),
        T.StructField(ENTRIES, T.LongType()),
    ]
)
# Loads of sources with other decimals merge, as all are stored alike.
STORED = T.DecimalType(38, 8)
PARTIAL_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in KEYS if name != YEAR]
    + [T.StructField(ENTRIES, T.LongType())]
    + [T.StructField(name, STORED) for name in (*SUMS, *MAXIMA)]
    + [T.StructField(LOAD, T.StringType()), T.StructField(YEAR, T.IntegerType()), T.StructField(MONTH, T.IntegerType())]
)


def partial_results(fact: DataFrame) -> DataFrame:
    """One row per key and month of the revenue accounts; the only step that reads fact rows."""
    return (
        revenue_accounts(fact)
        .groupBy(*KEYS, MONTH)
        .agg(
            F.count(F.lit(1)).alias(ENTRIES),
            *[F.sum(column).cast(STORED).alias(name) for name, column in SUMS.items()],
            *[F.max(column).cast(STORED).alias(name) for name, column in MAXIMA.items()],
        )
    )


@dataclass(frozen=True)
class MonthlyPartials:
    """Partial results in the folder ``root``; one load at a time may run."""

    spark: SparkSession
    root: str

    @property
    def log(self) -> Manifest:
        return Manifest(self.spark, f"{self.root}/log", LOG_SCHEMA)

    def months(self) -> DataFrame:
        """The load that counts for every month: ``number``, ``load``, year, month and number of entries."""
        newest = F.max_by(F.struct("number", LOAD, ENTRIES), "number").alias("newest")
        return (
            self.log.entries().groupBy(YEAR, MONTH).agg(newest)
            .select("newest.number", f"newest.{LOAD}", YEAR, MONTH, f"newest.{ENTRIES}")
        )

    def load(self, fact: DataFrame, months: Iterable[Month] | None = None) -> list[Month]:
        """Load months, each as a whole; they replace what was loaded of them before. Returns the months.

        ``months`` states which (year, month) pairs the load holds: a stated month without rows becomes empty, rows of others
        stop the load. Without it, the months that occur are taken. Rows without year or month stop it as
        well. The log is written last, so a load that breaks changes nothing.
        """
        load = uuid.uuid4().hex
        partial_results(fact).write.partitionBy(YEAR, MONTH).parquet(f"{self.root}/data/{LOAD}={load}")
        written = self._read([f"{LOAD}={load}"]).groupBy(YEAR, MONTH).agg(F.sum(ENTRIES).alias(ENTRIES))
        found = {(row[YEAR], row[MONTH]): row[ENTRIES] for row in written.collect()}  # one row per month
        stated = list(found) if months is None else sorted(set(months))
        strange = [month for month in found if None in month or month not in stated]
        if strange:
            raise ValueError(f"the load has rows of months it does not state: {strange}")
        number = (self.log.entries().agg(F.max("number")).first()[0] or 0) + 1
        if stated:
            self.log.append([(number, load, *month, found.get(month, 0)) for month in sorted(stated)])
        return sorted(stated)

    def _read(self, folders: Sequence[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], PARTIAL_SCHEMA)
        base = f"{self.root}/data"
        return (
            self.spark.read.schema(PARTIAL_SCHEMA).option("basePath", base).parquet(*[f"{base}/{folder}" for folder in folders])
        )

    def partials(self, years: Iterable[int] | None = None) -> DataFrame:
        """Partial results that count: one row per key and month. Only their folders are listed and read."""
        wanted = self.months().filter(F.col(ENTRIES) > 0)
        if years is not None:
            wanted = wanted.filter(F.col(YEAR).isin(*years))
        rows = wanted.collect()  # one row per month
        return self._read(sorted(f"{LOAD}={r[LOAD]}/{YEAR}={r[YEAR]}/{MONTH}={r[MONTH]}" for r in rows)).drop(LOAD)

    def net_aggregate(self, years: Iterable[int] | None = None) -> DataFrame:
        """Net collection and budget per key, and the number of entries, as from all fact rows."""
        gross, taken, planned, planned_taken = (F.sum(name) for name in SUMS)
        return self.partials(years).groupBy(*KEYS).agg(
            (gross - taken).cast("double").alias(NET_COLLECTED),
            (planned - planned_taken).cast("double").alias(NET_BUDGET),
            F.sum(ENTRIES).alias(ENTRIES),
        )

    def slices(self, rules: Sequence[Rule], horizon: Horizon) -> DataFrame:
        """All slices, to be projected like those of ``aggregate_slices``."""
        origins = sorted({rule.origin for rule in rules})
        return merged_slices(self.partials().filter(F.col(ORIGIN).isin(origins)), rules, horizon)
