"""Prefix lists as data against chains of conditions, and number formats settled per column."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fiscus.functions.formats import COMMA, POINT, amounts_in_own_format, format_profile, settled_formats
from fiscus.operators.prefixes import covered_prefixes, first_prefixes


def plan_lines(frame):
    return len(frame._jdf.queryExecution().optimizedPlan().toString().splitlines())


def first(code, prefixes):
    found = [(n, p) for n, p in enumerate(prefixes, 1) if code is not None and code.startswith(p)]
    return found[0] if found else (None, None)


def test_first_prefixes_equal_a_chain_of_conditions(spark):
    draw = random.Random(2)
    lists = {
        "short": ["11", "1", "112", "11", "9"],
        "long": ["".join(draw.choices("012", k=draw.randint(1, 6))) for _ in range(1500)],
        "none": ["xyz"],
    }
    codes = ["".join(draw.choices("0123", k=draw.randint(0, 7))) for _ in range(400)] + [None, "", "1", "11"] + ["1120"] * 500
    frame = spark.createDataFrame([(n, c) for n, c in enumerate(codes)], "n long, code string").repartition(3)
    for r in first_prefixes(frame, "code", lists).collect():
        assert [(r[f"{name}_ord"], r[f"{name}_prefix"]) for name in lists] == [first(r.code, p) for p in lists.values()]
    few = first_prefixes(frame, "code", {"long": lists["long"][:5]})
    assert plan_lines(first_prefixes(frame, "code", {"long": lists["long"]})) == plan_lines(few)
    with pytest.raises(ValueError):
        first_prefixes(frame.withColumn("long_ord", F.lit(1)), "code", lists)
    assert first_prefixes(frame.limit(0), "code", lists).count() == 0


def test_prefixes_that_another_one_covers(spark):
    found = covered_prefixes(spark, {"a": ["112", "11", "13"], "b": ["1", "2"]}).collect()
    assert [tuple(r) for r in found] == [("a", 1, "112", 2, "11")]


def amounts(spark, *columns):
    rows = list(zip(*columns))
    return spark.createDataFrame(rows, ", ".join(f"c{n} string" for n in range(len(columns))))


def test_a_column_settles_what_one_value_cannot(spark):
    frame = amounts(
        spark,
        ["1.234", "1.234,56", "7", "", "-12,5", None],
        ["1,234", "0.5", "1,234,567.25", " 3 ", "+9.", ".25"],
        ["1.234", "2.345", "7", None, None, None],
        ["1,234", "2.345.678", "7", None, None, None],
    )
    names = frame.columns
    profile = format_profile(frame, names)
    assert settled_formats(profile) == {"c0": COMMA, "c1": POINT, "c2": POINT, "c3": COMMA}
    first_column = {r["column"]: r for r in profile.collect()}["c0"].asDict()
    assert {k: v for k, v in first_column.items() if v} == {"column": "c0", "plain": 1, "comma_decimal": 2, "open_point": 1, "empty": 2}
    read = [tuple(None if v is None else Decimal(v).normalize() for v in r) for r in amounts_in_own_format(frame, names).collect()]
    assert [r[0] for r in read] == [Decimal(1234), Decimal("1234.56"), Decimal(7), None, Decimal("-12.5"), None]
    assert [r[1] for r in read] == [Decimal(1234), Decimal("0.5"), Decimal("1234567.25"), Decimal(3), Decimal(9), Decimal("0.25")]
    assert [r[2] for r in read][:2] == [Decimal("1.234"), Decimal("2.345")]
    assert [r[3] for r in read][:2] == [Decimal("1.234"), Decimal(2345678)]


@pytest.mark.parametrize("values", [["1,5", "1.5"], ["1.234", "1,234"], ["12x"], ["1.2.3"], ["-"]])
def test_columns_that_contradict_themselves_stop(spark, values):
    with pytest.raises(ValueError, match="no single number format"):
        settled_formats(format_profile(amounts(spark, values), ["c0"]))


def test_more_decimals_than_an_amount_keeps_stop_the_query(spark):
    with pytest.raises(PySparkException, match="unreadable amount in c0"):
        amounts_in_own_format(amounts(spark, ["0.1234567891"]), ["c0"]).collect()
