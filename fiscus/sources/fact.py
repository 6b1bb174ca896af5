"""Readers that bring the fact table into the declared schema."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fiscus.functions.numbers import locale_number
from fiscus.schema import AMOUNT, CODES, FACT_SCHEMA, MEASURES

# Wide enough to see whether a text has more decimals than an amount keeps.
FINEST = "decimal(38,18)"

SPLIT_OPTIONS = ("partitionColumn", "lowerBound", "upperBound", "numPartitions")


def read_fact_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Fact stored as Parquet, best partitioned by ``num_ano``.

    A code column that names partition folders would be read as a number and
    lose its leading zeros, so it is read again as text.
    """
    first = spark.read.parquet(path)
    numeric = [field.name for field in first.schema if field.name in CODES and not is_text(field.dataType)]
    if not numeric:
        return conform_fact(first)
    files = first.inputFiles()
    folders = [name for name in numeric if files and f"/{name}=" in files[0]]
    schema = T.StructType(
        [T.StructField(f.name, T.StringType() if f.name in folders else f.dataType) for f in first.schema]
    )
    return conform_fact(spark.read.schema(schema).parquet(path))


def is_text(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StringType, T.CharType, T.VarcharType))


def read_fact_table(spark: SparkSession, table: str) -> DataFrame:
    return conform_fact(spark.table(table))


def read_fact_jdbc(
    spark: SparkSession, options: Mapping[str, str], predicates: Sequence[str] | None = None
) -> DataFrame:
    """Fact in a database; address and credentials come from the caller only.

    The read must be split: by ``predicates``, disjoint WHERE conditions with
    one read task each (for example one per year and month), or by the options
    ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions``.
    """
    if predicates:
        rest = dict(options)
        url, table = rest.pop("url"), rest.pop("dbtable")
        return conform_fact(spark.read.jdbc(url, table, predicates=list(predicates), properties=rest))
    given = {name.lower() for name in options}
    missing = [name for name in SPLIT_OPTIONS if name.lower() not in given]
    if missing:
        raise ValueError(
            "the table would be read by one task: give predicates, or the options "
            f"{', '.join(SPLIT_OPTIONS)} (missing: {', '.join(missing)})"
        )
    return conform_fact(spark.read.format("jdbc").options(**options).load())


def conform_fact(raw: DataFrame) -> DataFrame:
    """Select the fact columns by name, without changing an amount or a code.

    Decimal amounts of any scale pass as they are. Text (with either decimal
    mark), doubles and integers become one wide decimal; null and blank amounts
    are null, and any other that cannot be read exactly stops the query with its column and value.
    Doubles are taken to eight decimals. Codes must be text: a number has lost its leading zeros.
    """
    found = {field.name: field.dataType for field in raw.schema}
    missing = [field.name for field in FACT_SCHEMA if field.name not in found]
    if missing:
        raise ValueError(f"fact table lacks columns: {', '.join(missing)}")
    numbers = [name for name in CODES if not is_text(found[name])]
    if numbers:
        raise ValueError(f"codes are stored as numbers, their leading zeros are lost: {', '.join(numbers)}")

    def conformed(field):
        name, kind = field.name, found[field.name]
        if name in MEASURES:
            return F.col(name) if isinstance(kind, T.DecimalType) else exact_amount(name, kind).alias(name)
        if kind == field.dataType:
            return F.col(name)
        return F.col(name).cast(field.dataType).alias(name)

    return raw.select(*[conformed(field) for field in FACT_SCHEMA])


def exact_amount(name: str, kind: T.DataType) -> Column:
    """The amount as a wide decimal; an unreadable one raises an error when it is met."""
    value = F.col(name)
    if is_text(kind):
        amount = locale_number(value, AMOUNT.simpleString())
        finer = locale_number(value, FINEST)
        amount = F.when(amount == finer, amount)
        empty = value.isNull() | (F.trim(value) == "")
    else:
        amount = value.try_cast(AMOUNT)
        empty = value.isNull()
    error = F.raise_error(F.concat(F.lit(f"unreadable amount in {name}: "), value.cast("string")))
    return F.when(empty, F.lit(None).cast(AMOUNT)).otherwise(F.coalesce(amount, error.cast(AMOUNT)))
