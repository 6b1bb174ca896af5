"""Monthly partial results against aggregates of all entries."""

from __future__ import annotations

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fiscus.operators.aggregate import aggregate_slices, net_sum
from fiscus.operators.filters import revenue_accounts
from fiscus.operators.incremental import ENTRIES, MonthlyPartials
from fiscus.plans.catalogue import CATALOGUE
from fiscus.schema import (
    BUDGETED, BUDGETED_DEDUCTION, COLLECTED, COLLECTED_DEDUCTION, KEYS, MONTH, NET_BUDGET, NET_COLLECTED, YEAR, Horizon,
)
from tests.conftest import fact_row, make_fact


def entries(years, seed, count=200):
    draw = random.Random(seed)
    names = ["ICMS - Principal", "IPVA", "L.C. N. 87/96", "SUS", "FNDE", None]
    return [
        fact_row(origin=draw.choice(["11", "16", "17", "76"]), name=draw.choice(names), year=draw.choice(years),
                 month=draw.randint(1, 12), account=draw.choice(["62121000000", "52111000000", "99"]),
                 collected=draw.choice([None, str(draw.randint(0, 9000) / 100)]), deduction=str(draw.randint(0, 300) / 100),
                 budgeted=str(draw.randint(0, 900)), budget_deduction=draw.choice([None, "1.25"]))
        for _ in range(count)
    ]


def full(fact):
    return revenue_accounts(fact).groupBy(*KEYS).agg(
        net_sum(COLLECTED, COLLECTED_DEDUCTION).alias(NET_COLLECTED), net_sum(BUDGETED, BUDGETED_DEDUCTION).alias(NET_BUDGET),
        F.count("*").alias(ENTRIES),
    )


def rows(frame):
    return sorted(map(repr, map(tuple, frame.collect())))


@pytest.fixture
def partials(spark, tmp_path):
    return MonthlyPartials(spark, str(tmp_path / "partials"))


def test_added_and_restated_months_equal_a_full_run(spark, partials):
    old, new = entries([2018, 2019], 1), entries([2020], 2)
    partials.load(make_fact(spark, old))
    partials.load(make_fact(spark, new))
    assert rows(partials.net_aggregate()) == rows(full(make_fact(spark, old + new)))
    # Restated with smaller amounts: sums and maxima of the month before must not stay.
    restated = [fact_row(origin="17", name="L.C. N. 87/96", year=2019, month=m, collected="0.01", deduction="0.02") for m in (3, 4)]
    partials.load(make_fact(spark, restated))
    left = [r for r in old if (r[6], r[7]) not in {(2019, 3), (2019, 4)}] + new + restated
    assert rows(partials.net_aggregate()) == rows(full(make_fact(spark, left)))
    assert rows(partials.net_aggregate(years=[2020])) == rows(full(make_fact(spark, new)))
    horizon = Horizon()
    assert rows(partials.slices(CATALOGUE, horizon).select(*sorted(partials.slices(CATALOGUE, horizon).columns)).drop(*[
        c for c in partials.slices(CATALOGUE, horizon).columns if c.startswith(("sum_", "max_"))
    ])) == rows(aggregate_slices(make_fact(spark, left), CATALOGUE, horizon).drop(*[
        c for c in partials.slices(CATALOGUE, horizon).columns if c.startswith(("sum_", "max_"))
    ]).select(*sorted(["slice_id", *KEYS])))


def test_slices_keep_maxima_and_sums(spark, partials):
    fact = make_fact(spark, entries([2019, 2020], 4, 400))
    partials.load(fact)
    horizon = Horizon()
    amounts = [f"cast({name} AS double) AS {name}" for name in
               ("sum_collected", "sum_collected_deduction", "sum_budgeted", "sum_budgeted_deduction", "max_collected", "max_collected_deduction")]
    shown = ["slice_id", *KEYS, *amounts]
    assert rows(partials.slices(CATALOGUE, horizon).selectExpr(*shown)) == rows(
        aggregate_slices(fact, CATALOGUE, horizon).selectExpr(*shown)
    )


def test_a_month_stated_without_rows_becomes_empty(spark, partials):
    old = entries([2019], 5)
    partials.load(make_fact(spark, old))
    assert partials.load(make_fact(spark, []), months=[(2019, 7)]) == [(2019, 7)]
    assert rows(partials.net_aggregate()) == rows(full(make_fact(spark, [r for r in old if r[7] != 7])))
    empty = partials.months().filter(f"{MONTH} = 7").first()
    assert (empty[ENTRIES], empty.number) == (0, 2)


def test_loads_that_break_or_state_other_months_change_nothing(spark, partials):
    old = entries([2019], 6)
    partials.load(make_fact(spark, old))
    before = rows(partials.net_aggregate())
    with pytest.raises(ValueError):
        partials.load(make_fact(spark, entries([2019], 7)), months=[(2019, 1)])
    with pytest.raises(ValueError):
        partials.load(make_fact(spark, [fact_row(month=None)]))
    with pytest.raises(PySparkException):
        partials.load(make_fact(spark, old).withColumn(COLLECTED, F.raise_error(F.lit("lost")).cast("decimal(18,2)")))
    assert rows(partials.net_aggregate()) == before


def test_only_counting_months_are_read(spark, partials):
    assert partials.net_aggregate().count() == 0 and partials.months().count() == 0
    partials.load(make_fact(spark, [fact_row(year=2019, month=m, collected="5") for m in (1, 2, 3)]))
    partials.load(make_fact(spark, [fact_row(year=2019, month=2, collected="6")]))
    files = partials.partials().inputFiles()
    assert len({f.rsplit("/", 1)[0] for f in files}) == 3
    assert {r.number for r in partials.months().collect()} == {1, 2}
    assert len({f.rsplit("/", 1)[0] for f in partials.partials(years=[2018]).inputFiles()}) == 0
