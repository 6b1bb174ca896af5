"""Replace the published table in a Parquet folder, a catalog or a database."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

# Options of a split read, which a read of one number does not take.
SPLIT_OPTIONS = {"partitioncolumn", "lowerbound", "upperbound", "numpartitions"}


def publish_parquet(result: DataFrame, path: str) -> DataFrame:
    """Replace the Parquet folder and read it back."""
    rows = counted_write(result, lambda frame: frame.write.mode("overwrite").parquet(path))
    return checked(result.sparkSession.read.parquet(path), result, rows)


def publish_table(result: DataFrame, table: str) -> DataFrame:
    """Replace the catalog table, stored as Parquet, and read it back."""
    rows = counted_write(result, lambda frame: frame.write.mode("overwrite").format("parquet").saveAsTable(table))
    return checked(result.sparkSession.table(table), result, rows)


def publish_jdbc(result: DataFrame, options: Mapping[str, str]) -> None:
    """Replace the database table; address and credentials come from the caller only.

    Tasks write in parallel, each in its own transaction. A task that is lost
    after its commit is written again on another executor, so the database is
    asked for its count afterwards; one number comes back, and the result runs once.
    """
    rows = counted_write(
        result, lambda frame: frame.write.format("jdbc").mode("overwrite").options(**options).save()
    )
    plain = {name.lower(): value for name, value in options.items() if name.lower() not in SPLIT_OPTIONS}
    plain["dbtable"] = f"(SELECT count(*) AS n FROM {plain['dbtable']}) q"
    published = result.sparkSession.read.format("jdbc").options(**plain).load().first()[0]
    check_rows(int(published), rows)


def counted_write(result: DataFrame, write) -> int:
    """Write and count the rows on their way, in one run of the plan."""
    seen = Observation()
    write(result.observe(seen, F.count(F.lit(1)).alias("rows")))
    return seen.get["rows"]


def checked(published: DataFrame, expected: DataFrame, rows: int) -> DataFrame:
    """The published table, if it has the columns of the result and all its rows."""
    if published.dtypes != expected.dtypes:
        raise RuntimeError("the published table does not have the schema of the result")
    check_rows(published.count(), rows)
    return published


def check_rows(published: int, expected: int) -> None:
    if published != expected:
        raise RuntimeError(f"published {published} rows instead of {expected}; publish again")
