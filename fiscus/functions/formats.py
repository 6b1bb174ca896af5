"""The number format of amounts that come as text, settled per column from all its values.

One value alone cannot tell whether ``1.234`` is a thousand or a little more than one. A column can: a mark with other
than three digits behind it, or the last of two different marks, is the decimal mark, and a mark that occurs twice
in a value parts thousands. One pass counts these patterns for all columns; the values are then read alike.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiscus.schema import AMOUNT

# Patterns of a value without its sign; every value has exactly one.
PLAIN = r"^[0-9]+$"
POINT_DECIMAL = r"^([0-9]{1,3}(,[0-9]{3})+\.[0-9]*|[0-9]{1,3}(,[0-9]{3}){2,}|[0-9]*\.([0-9]{0,2}|[0-9]{4,})|[0-9]{4,}\.[0-9]{3}|\.[0-9]{3})$"
COMMA_DECIMAL = r"^([0-9]{1,3}(\.[0-9]{3})+,[0-9]*|[0-9]{1,3}(\.[0-9]{3}){2,}|[0-9]*,([0-9]{0,2}|[0-9]{4,})|[0-9]{4,},[0-9]{3}|,[0-9]{3})$"
OPEN_POINT = r"^[0-9]{1,3}\.[0-9]{3}$"  # a thousand, or a decimal point
OPEN_COMMA = r"^[0-9]{1,3},[0-9]{3}$"
PATTERNS = {
    "plain": PLAIN, "point_decimal": POINT_DECIMAL, "comma_decimal": COMMA_DECIMAL, "open_point": OPEN_POINT, "open_comma": OPEN_COMMA,
}
COUNTS = (*PATTERNS, "empty", "unreadable")


@dataclass(frozen=True)
class NumberFormat:
    decimal: str
    thousands: str


POINT, COMMA = NumberFormat(".", ","), NumberFormat(",", ".")


def _bare(column: str) -> Column:
    return F.regexp_replace(F.trim(F.col(f"`{column}`")), r"^[+-]\s*", "")


def pattern_of(column: str) -> Column:
    """The name of the pattern of a text value."""
    bare = _bare(column)
    value = F.col(f"`{column}`")
    found = F.when(value.isNull() | (F.trim(value) == ""), "empty").when(~bare.rlike("[0-9]"), "unreadable")
    for name, pattern in PATTERNS.items():
        found = found.when(bare.rlike(pattern), name)
    return found.otherwise("unreadable")


def format_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column`` and how many values have each pattern; one pass for all columns, counted on the map side."""
    kinds = F.array(*[F.struct(F.lit(name).alias("column"), pattern_of(name).alias("kind")) for name in columns])
    counted = df.select(F.inline(kinds)).groupBy("column").agg(
        *[F.count(F.when(F.col("kind") == name, 1)).alias(name) for name in COUNTS]
    )
    return counted


def settled_formats(profile: DataFrame) -> dict[str, NumberFormat]:
    """The format of every column, from one row per column; columns that contradict themselves stop with their counts.

    Where nothing decides, as in columns of plain integers, a single mark is the decimal mark: it is read as the
    readers of one value read it, unless both marks occur.
    """
    formats = {}
    for row in profile.collect():
        point, comma = row.point_decimal, row.comma_decimal
        undecided = not point and not comma and row.open_point and row.open_comma
        if (point and comma) or undecided or row.unreadable:
            raise ValueError(f"no single number format in {row['column']}: {row.asDict()}")
        formats[row["column"]] = COMMA if comma or (not point and row.open_comma) else POINT
    return formats


def read_amounts(df: DataFrame, formats: Mapping[str, NumberFormat]) -> DataFrame:
    """The columns as exact decimals; empty values are null, and more decimals than an amount keeps stop the query."""

    def amount(name: str, own: NumberFormat) -> Column:
        text = F.regexp_replace(F.trim(F.col(f"`{name}`")), r"\s", "")
        dotted = F.replace(F.replace(text, F.lit(own.thousands), F.lit("")), F.lit(own.decimal), F.lit("."))
        value = dotted.try_cast(AMOUNT)
        exact = value == dotted.try_cast("decimal(38,18)")
        error = F.raise_error(F.concat(F.lit(f"unreadable amount in {name}: "), text)).cast(AMOUNT)
        return F.when(text.isNull() | (text == ""), F.lit(None).cast(AMOUNT)).when(exact, value).otherwise(error)

    return df.withColumns({name: amount(name, own) for name, own in formats.items()})


def amounts_in_own_format(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Settle the format of each column over all rows, then read them."""
    return read_amounts(df, settled_formats(format_profile(df, columns)))
