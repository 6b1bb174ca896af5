"""Regulatory flags set from prefixes of the revenue nature."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fiscus.functions.predicates import all_of, starts_with_any, starts_with_none, text_literal
from fiscus.schema import ACCOUNT, NATURE, RCL, RLI
from fiscus.sources.local import literal_table

# Nature prefixes of net current revenue, in report order.
RCL_PREFIXES = (
    "1118021", "1118012", "1118013", "111303", "1118014", "112", "113", "13", "14", "15", "16",
    "1718011", "1718061", "1718016", "17580111", "1718017", "1718018", "171802", "171803", "171812",
    "171805", "171807", "1728", "173", "175899", "174", "176", "177", "17181", "19", "22200012",
)
# Nature prefixes of net tax revenue, in report order, and the
# accounts that are left out of it.
RLI_PREFIXES = (
    "1118021", "11180212", "11180214", "11180213", "11180131", "11180132", "11180133", "11180134",
    "11180121", "11180122", "11180123", "11180124", "111303", "1718011", "171806", "1718016", "1718018",
)
RLI_EXCLUDED_ACCOUNTS = ("6213101", "521120101")

AUDIT_SCHEMA = T.StructType(
    [
        T.StructField("flag", T.StringType()),
        T.StructField("ord", T.IntegerType()),
        T.StructField("prefix", T.StringType()),
    ]
)


def flag_rcl(df: DataFrame) -> DataFrame:
    return df.withColumn(RCL, _yes_or_blank(starts_with_any(NATURE, RCL_PREFIXES)))


def flag_rli(df: DataFrame) -> DataFrame:
    taken = [starts_with_any(NATURE, RLI_PREFIXES), starts_with_none(ACCOUNT, RLI_EXCLUDED_ACCOUNTS)]
    return df.withColumn(RLI, _yes_or_blank(all_of(taken)))


def _yes_or_blank(condition: str) -> Column:
    """An unknown code matches nothing: NULL conditions fall through to the blank."""
    return F.when(F.expr(condition), "S").otherwise("")


def flag_audit(df: DataFrame) -> DataFrame:
    """How many rows the prefixes of each list match, counted up in list order.

    Each row is counted at the first prefix it matches; running totals over
    the prefix list (a few dozen rows) then give the cumulative counts.
    """
    lists = {RCL: RCL_PREFIXES, RLI: RLI_PREFIXES}
    hits = df.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(flag).alias("flag"), _first_match(prefixes).alias("ord"))
                    for flag, prefixes in lists.items()
                ]
            )
        ).alias("hit")
    )
    counts = hits.select("hit.flag", "hit.ord").filter("ord IS NOT NULL").groupBy("flag", "ord").count()
    prefixes = literal_table(
        df.sparkSession,
        [(flag, ord_, prefix) for flag, items in lists.items() for ord_, prefix in enumerate(items, 1)],
        AUDIT_SCHEMA,
    )
    running = Window.partitionBy("flag").orderBy("ord")
    return prefixes.join(counts, ["flag", "ord"], "left").select(
        "flag",
        "ord",
        "prefix",
        F.sum(F.coalesce("count", F.lit(0))).over(running).alias("matched_rows"),
    )


def _first_match(prefixes: Sequence[str]) -> Column:
    tests = [
        f"WHEN startswith({NATURE}, {text_literal(prefix)}) THEN {position}"
        for position, prefix in enumerate(prefixes, 1)
    ]
    return F.expr(f"CASE {' '.join(tests)} END")
