"""Small literal tables whose size is fixed by the code or the caller."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def literal_table(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A local relation with exact size statistics, so that Spark knows how small it is."""
    columns = zip(*rows) if rows else [[] for _ in schema]
    arrow_schema = to_arrow_schema(schema)
    arrays = [pa.array(list(values), type=field.type) for values, field in zip(columns, arrow_schema)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow_schema), schema)
