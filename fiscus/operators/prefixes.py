"""Prefix lists as data: the first prefix of a list that a code starts with.

A list is indexed by the length of its prefixes. A code is cut to each length that occurs and looked up by
equality, so a list of thousands of prefixes costs as many look-ups as it has lengths, and the plan stays as short as for
one prefix. Codes are looked up once each, not once per row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fiscus.shared import stored
from fiscus.sources.local import literal_table

PrefixLists = Mapping[str, Sequence[str]]

INDEX_SCHEMA = T.StructType(
    [
        T.StructField("list", T.StringType()),
        T.StructField("ord", T.IntegerType()),
        T.StructField("cut", T.StringType()),
        T.StructField("width", T.IntegerType()),
    ]
)


def prefix_index(spark: SparkSession, lists: PrefixLists) -> DataFrame:
    """``list``, ``ord`` (from 1), ``cut`` (the prefix) and ``width``; of equal prefixes of a list the first counts."""
    rows = []
    for name, prefixes in lists.items():
        first = {prefix: n for n, prefix in reversed(list(enumerate(prefixes, 1)))}
        rows += [(name, n, prefix, len(prefix)) for prefix, n in first.items()]
    return literal_table(spark, sorted(rows), INDEX_SCHEMA)


def _cuts(codes: DataFrame, column: str, widths: Sequence[int]) -> DataFrame:
    """Every code, cut to each of the widths it reaches."""
    cuts = F.array(*[F.struct(F.lit(width).alias("width"), F.left(F.col(column), F.lit(width)).alias("cut")) for width in widths])
    reached = F.filter(cuts, lambda c: F.length(c["cut"]) == c["width"])
    return codes.select(column, F.explode(reached).alias("c")).select(column, "c.width", "c.cut")


def first_prefixes(df: DataFrame, code: str, lists: PrefixLists) -> DataFrame:
    """``df`` with ``<list>_ord`` and ``<list>_prefix`` for each list, null where no prefix fits.

    Prefixes are tried in list order, as a chain of conditions would. Null codes match nothing, the empty prefix matches
    every other code. The look-up table has a row per distinct code; it is stored, so Spark knows its size when it
    chooses how to join it, and splits a code that holds a large share of all rows.
    """
    columns = [f"{name}_{part}" for name in lists for part in ("ord", "prefix")]
    clash = {code, *df.columns} & set(columns)
    if clash:
        raise ValueError(f"columns exist already: {', '.join(sorted(clash))}")
    index = prefix_index(df.sparkSession, lists)
    widths = sorted({len(prefix) for prefixes in lists.values() for prefix in prefixes})
    codes = df.select(F.col(code).alias("code")).filter("code is not null").distinct()
    hits = _cuts(codes, "code", widths).join(index, ["width", "cut"])
    best = hits.groupBy("code").agg(
        *[F.min(F.when(F.col("list") == name, F.struct("ord", "cut"))).alias(name) for name in lists]
    )
    parts = [F.col(f"`{name}`")[part].alias(f"{name}_{alias}") for name in lists for part, alias in (("ord", "ord"), ("cut", "prefix"))]
    found = stored(best.select(F.col("code").alias("matched_code"), *parts), "prefix-matches")
    return df.join(found, df[code] == found["matched_code"], "left").drop("matched_code")


def covered_prefixes(spark: SparkSession, lists: PrefixLists) -> DataFrame:
    """Prefixes that another one of their list covers: they decide nothing but the order of the report."""
    index = prefix_index(spark, lists)
    widths = sorted({len(prefix) for prefixes in lists.values() for prefix in prefixes})
    own = index.select("list", F.col("ord").alias("covered_ord"), F.col("cut").alias("covered"))
    cuts = _cuts(own.select("covered").distinct(), "covered", widths).join(own, "covered")
    return (
        cuts.join(index, ["list", "width", "cut"])
        .filter("cut <> covered")
        .select("list", "covered_ord", "covered", F.col("ord").alias("by_ord"), F.col("cut").alias("by"))
    )
