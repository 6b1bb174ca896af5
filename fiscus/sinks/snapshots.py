"""Published tables as snapshots: a new folder, a check of its content, then one switch.

A publication never touches the files of the one before. Readers that have begun go on with the old
snapshot, later ones get the new one, and a publication that fails at any point leaves the old one current. Old
snapshots can be read by their number until they are released.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fiscus.functions.predicates import text_literal
from fiscus.sinks.fingerprint import Fingerprint, fingerprint, observed_write
from fiscus.sinks.manifest import Manifest

LOG_SCHEMA = T.StructType(
    [
        T.StructField("version", T.LongType()),
        T.StructField("folder", T.StringType()),
        T.StructField("rows", T.LongType()),
        T.StructField("total", T.DecimalType(38, 0)),
        T.StructField("parity", T.LongType()),
    ]
)


def _log(spark: SparkSession, root: str) -> Manifest:
    return Manifest(spark, f"{root}/log", LOG_SCHEMA)


def snapshots(spark: SparkSession, root: str) -> DataFrame:
    """All snapshots that were ever current: ``version``, ``folder`` and fingerprint."""
    return _log(spark, root).entries()


def snapshot_entry(spark: SparkSession, root: str, version: int | None = None) -> T.Row | None:
    """The log entry of a version, or of the current one; none if there is none.

    Two publications that overlap may log the same version; the folder's name then decides for all readers alike.
    """
    found = snapshots(spark, root)
    chosen = found if version is None else found.filter(F.col("version") == version)
    return chosen.orderBy(F.desc("version"), F.desc("folder")).first()


def read_snapshot(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The current snapshot, or an earlier one that is not released yet."""
    entry = snapshot_entry(spark, root, version)
    if entry is None:
        raise LookupError(f"nothing is published in {root}" if version is None else f"no version {version} in {root}")
    return spark.read.parquet(f"{root}/{entry.folder}")


def publish_snapshot(result: DataFrame, root: str) -> DataFrame:
    """Write the result beside the current snapshot, check what was stored, make it current and read it.

    The content is hashed in the write and hashed again from the stored files. If schema or content differ,
    an error is raised and the old snapshot stays current.
    """
    spark = result.sparkSession
    folder = f"data/{uuid.uuid4().hex}"
    written = observed_write(result, lambda frame: frame.write.parquet(f"{root}/{folder}"))
    stored = spark.read.parquet(f"{root}/{folder}")
    check_content(stored, result, written)
    current = snapshot_entry(spark, root)
    version = current.version + 1 if current else 1
    _log(spark, root).append([(version, folder, written.rows, written.total, written.parity)])
    return stored


def check_content(stored: DataFrame, expected: DataFrame, written: Fingerprint) -> None:
    if stored.dtypes != expected.dtypes:
        raise RuntimeError("the stored table does not have the schema of the result")
    found = fingerprint(stored)
    if found != written:
        raise RuntimeError(f"the stored table differs from the result: {found} instead of {written}; publish again")


def publish_table_snapshot(result: DataFrame, table: str, root: str) -> DataFrame:
    """The same for a catalog table, stored as Parquet outside the warehouse: its location is the switch.

    A table that does not exist is created. One with other columns is left as it is, with an error.
    """
    spark = result.sparkSession
    known = spark.catalog.tableExists(table)
    if known and spark.table(table).dtypes != result.dtypes:
        raise ValueError(f"{table} has other columns than the result")
    publish_snapshot(result, root)
    location = text_literal(f"{root}/{snapshot_entry(spark, root).folder}")
    if known:
        spark.sql(f"ALTER TABLE {table} SET LOCATION {location}")
        spark.catalog.refreshTable(table)
    else:
        spark.sql(f"CREATE TABLE {table} USING PARQUET LOCATION {location}")
    return spark.table(table)


def release_snapshots(spark: SparkSession, root: str, keep: int = 2, unlisted: bool = False) -> list[str]:
    """Delete the files of all but the newest ``keep`` snapshots; returns the folders.

    ``unlisted`` also deletes folders that no entry names, which broken publications leave; none may be running then.
    Their log entries stay. Nothing else removes files, so readers of a kept snapshot are never disturbed.
    """
    if keep < 1:
        raise ValueError("the current snapshot must be kept")
    listed = [row.folder for row in snapshots(spark, root).orderBy(F.desc("version"), F.desc("folder")).select("folder").collect()]
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    data = hadoop(f"{root}/data")
    files = data.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    present = [f"data/{status.getPath().getName()}" for status in files.listStatus(data)] if files.exists(data) else []
    kept = set(listed[:keep])
    gone = [folder for folder in present if folder not in kept and (unlisted or folder in listed)]
    for folder in gone:
        files.delete(hadoop(f"{root}/{folder}"), True)
    return sorted(gone)
