"""An append-only log beside stored data; its entries say which folders count.

Every append is one Parquet file, which its writer renames into place when it is complete. A reader sees
the entry or does not see it, never a part of it, so an entry is the one switch that makes data current.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from fiscus.sources.local import literal_table


class Manifest:
    """Entries of ``schema`` in a folder; they grow by a few rows a publication, not with the data."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType):
        self.spark, self.folder, self.schema = spark, folder, schema

    def entries(self) -> DataFrame:
        """All entries so far; none if nothing was logged yet."""
        try:
            return self.spark.read.schema(self.schema).parquet(self.folder)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.schema)

    def append(self, rows: list[tuple]) -> None:
        """Log rows in one file; they appear together."""
        literal_table(self.spark, rows, self.schema).coalesce(1).write.mode("append").parquet(self.folder)
