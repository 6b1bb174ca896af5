"""Where intermediate and published tables may lie so that every machine sees them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# For each open ``scratch``, from the outermost to the innermost, the folders of its tables.
_open: ContextVar[tuple[list[str], ...]] = ContextVar("scratch folders", default=())


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    A session without that setting gets a temporary folder if it runs on one
    machine (``local`` master) and an error otherwise: executors of a cluster
    would each write to a disk of their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        folder = tempfile.mkdtemp(prefix="fiscus-")
        spark.conf.set("spark.checkpoint.dir", folder)
        return folder
    raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, name: str, outlives: bool = False) -> DataFrame:
    """The frame written to the shared folder and read back.

    Cuts the lineage: later steps read files that outlive any executor, and a
    result that is used several times is computed once. ``outlives`` keeps the table when the innermost ``scratch``
    ends; one around it, if any, takes it over.
    """
    folder = new_folder(frame.sparkSession, name)
    scopes = _open.get()[:-1] if outlives else _open.get()
    if scopes:
        scopes[-1].append(folder)
    frame.write.parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """Queries that start inside run with this setting of the session."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Jobs that run inside hand Python batches of fewer rows, which bounds the memory of tasks on long texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    with setting(spark, name, str(min(rows, before) if before > 0 else rows)):
        yield


def delete_folders(spark: SparkSession, folders: list[str]) -> None:
    """Delete folders on whatever file system they lie; missing ones are no error."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for folder in folders:
        path = hadoop(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables stored inside are deleted at the end, also after an error.

    Frames that read them must not be used any more then; a result is stored with ``outlives``.
    """
    folders: list[str] = []
    token = _open.set((*_open.get(), folders))
    try:
        yield
    finally:
        _open.reset(token)
        delete_folders(spark, folders)
