"""A fingerprint of the content of a table that does not depend on the order of its rows.

Each row is hashed with its column names' order and its nulls. The number of rows, the sum of their hashes
and the XOR of their hashes make the fingerprint. A changed cell changes sum and XOR. A row that is doubled while another
one is lost keeps the number, and changes the sum. All three combine on the map side, so a table of any size
sends one row per task, and they can be observed while the table is written.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTS = ("rows", "total", "parity")


@dataclass(frozen=True)
class Fingerprint:
    rows: int
    total: Decimal | None  # none for an empty table
    parity: int | None


def row_hash(schema: T.StructType) -> Column:
    """64 bits of a row; columns are taken by name, and a null counts as a value of its own in its place."""
    parts = []
    for field in sorted(schema.fields, key=lambda f: f.name):
        column = F.col(f"`{field.name}`")
        nested = isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType))
        parts += [column.isNull(), F.to_json(column, {"ignoreNullFields": "false"}) if nested else column]
    return F.xxhash64(*parts)


def fingerprint_parts(schema: T.StructType) -> list[Column]:
    """The aggregates ``rows``, ``total`` and ``parity``."""
    hashed = row_hash(schema)
    return [
        F.count(F.lit(1)).alias("rows"),
        F.sum(hashed.cast("decimal(28,0)")).alias("total"),
        F.bit_xor(hashed).alias("parity"),
    ]


def fingerprint(df: DataFrame) -> Fingerprint:
    return Fingerprint(**df.agg(*fingerprint_parts(df.schema)).first().asDict())


def fingerprints_by(df: DataFrame, *keys: str) -> DataFrame:
    """One fingerprint per group, to see where two tables differ."""
    return df.groupBy(*keys).agg(*fingerprint_parts(df.schema))


def observed_write(result: DataFrame, write) -> Fingerprint:
    """Write and take the fingerprint of the rows on their way, in one run of the plan."""
    seen = Observation()
    write(result.observe(seen, *fingerprint_parts(result.schema)))
    return Fingerprint(**{name: seen.get[name] for name in PARTS})
