"""Balanced database splits on given histograms; rules as data against rules as conditions."""

from __future__ import annotations

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from fiscus.operators.aggregate import aggregate_slices
from fiscus.operators.dimension import aggregate_slices_by_text, rules_by_text
from fiscus.plans.catalogue import CATALOGUE
from fiscus.schema import MONTH, YEAR, Horizon
from fiscus.sources import splits
from fiscus.sources.splits import balanced_bins, month_counts, split_conditions
from testbed.lineitem_fact import fact_from_lineitem
from tests.conftest import SMALL_TABLES, fact_row, make_fact


def test_bins_are_nearly_equal_and_hold_every_month_once():
    draw = random.Random(1)
    for bins in (1, 3, 8, 40, 200):
        rows = {(year, month): draw.choice([0, 5, 100, 1000]) for year in range(2010, 2020) for month in range(1, 13)}
        found = balanced_bins(rows, bins)
        assert sorted(m for b in found for m in b) == sorted(rows) and len(found) == min(bins, len(rows))
        sizes = [sum(rows[m] for m in b) for b in found]
        assert max(sizes) - min(sizes) <= max(rows.values())
    assert balanced_bins({}, 4) == [] and split_conditions([]) == ["1 = 1"]
    with pytest.raises(ValueError):
        balanced_bins({(2019, 1): 3}, 0)


def test_every_row_meets_exactly_one_condition(spark):
    rows = [(y, m) for y in (2018, 2019, 2020, None) for m in (1, 2, 3, 12, None)]
    frame = spark.createDataFrame(rows, f"{YEAR} int, {MONTH} int")
    conditions = split_conditions(balanced_bins({(2018, 1): 9, (2018, 2): 4, (2019, 1): 5, (2019, 12): 1}, 3))
    met = frame.select(*[F.coalesce(F.expr(c), F.lit(False)).cast("int").alias(f"c{n}") for n, c in enumerate(conditions)]).collect()
    assert len(conditions) == 4 and all(sum(r) == 1 for r in met)


def test_the_count_is_asked_of_the_database(monkeypatch):
    class Reader:
        def format(self, name):
            assert name == "jdbc"
            return self

        def options(self, **given):
            self.given = given
            return self

        def load(self):
            return self

        def collect(self):
            return [(2019, 1, 10), (2019, 2, 20), (None, 3, 1)]

    class Session:
        read = Reader()

    found = month_counts(Session, {"url": "jdbc:x:y", "DBTable": "fact", "numPartitions": "4"})
    assert found == {(2019, 1): 10, (2019, 2): 20}
    assert Session.read.given == {
        "url": "jdbc:x:y", "dbtable": f"(SELECT {YEAR}, {MONTH}, count(*) AS n FROM fact GROUP BY {YEAR}, {MONTH}) q"
    }
    asked = {}
    monkeypatch.setattr(splits, "read_fact_jdbc", lambda spark, options, predicates: asked.update(options, conditions=predicates))
    splits.read_fact_balanced(Session, {"url": "jdbc:x:y", "DBTable": "fact"}, 2)
    assert asked["dbtable"] == "fact" and len(asked["conditions"]) == 3


def rows(frame):
    return sorted(map(repr, map(tuple, frame.select(*sorted(frame.columns)).collect())))


def test_rules_as_data_give_the_same_slices(spark):
    horizon = Horizon()
    fact = fact_from_lineitem(spark, SMALL_TABLES)
    assert rows(aggregate_slices_by_text(fact, CATALOGUE, horizon)) == rows(aggregate_slices(fact, CATALOGUE, horizon))
    odd = make_fact(spark, [
        fact_row(origin="17", name=None, fund="0128000000", collected="3"), fact_row(origin="17", name="IPI", fund=None, collected="2"),
        fact_row(origin="12", name=None, collected="1"), fact_row(origin="13", name="x", month=None, collected="4"),
        fact_row(origin="16", name="SUS", year=None, month=9), fact_row(origin=None),
    ])
    assert rows(aggregate_slices_by_text(odd, CATALOGUE, horizon)) == rows(aggregate_slices(odd, CATALOGUE, horizon))


def test_a_thousand_rules_are_no_longer_plan(spark):
    fact = fact_from_lineitem(spark, SMALL_TABLES)
    many = [replace(CATALOGUE[n % len(CATALOGUE)], slice_id=f"r{n}") for n in range(1000)]

    def plan(rules):
        found = rules_by_text(fact, rules, Horizon())
        return found, found._jdf.queryExecution().optimizedPlan().numberedTreeString().count("\n")

    (few, short), (all_, long) = plan(CATALOGUE), plan(many)
    assert short == long
    matched = {r.nom_detalhamento: len(r.taken) for r in few.collect()}
    assert {r.nom_detalhamento: len(r.taken) for r in all_.collect()} == {name: 25 * n for name, n in matched.items()}
