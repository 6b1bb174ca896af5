"""Held-out accuracy of the two classifiers, and their odd rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fiscus.llm import queries
from fiscus.llm.language_id import features, identify, language_families
from fiscus.llm.quality import Rules, fit_rules, score_quality

TABLES = "/root/testdata/sf0.01"

SYLLABLES = {"aa": "bako lumi sera", "ab": "bako lumi tero", "ba": "zhrx qvik xuwz", "bb": "zhrx qvik wyzk"}


def language_rows(count, seed):
    draw = random.Random(seed)
    return [
        (n, " ".join("".join(draw.choices(SYLLABLES[lang].split(), k=2)) for _ in range(30)), lang)
        for n, lang in enumerate(draw.choices(sorted(SYLLABLES), k=count))
    ]


def test_families_hold_what_is_alike():
    texts = {lang: " ".join([words] * 20) for lang, words in SYLLABLES.items()}
    found = language_families({lang: features(text) for lang, text in texts.items()})
    assert found["aa"] == found["ab"] != found["ba"] == found["bb"]


def test_close_languages_are_told_apart(spark):
    schema = "doc_id long, text string, lang string"
    train, new = (spark.createDataFrame(language_rows(n, n), schema) for n in (200, 100))
    rows = identify(new, train, per_language=40).join(new, "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(spark):
    schema = "doc_id long, text string, lang string"
    train = spark.createDataFrame(language_rows(60, 3) + [(900, None, "aa"), (901, "12", "zz"), (902, "bako", None)], schema)
    odd = [(1, None, "aa"), (2, "", "aa"), (3, "12 !?", "aa"), (None, "bakolumi serabako", "x"), (5, "x" * 200_000, None), (5, "日本", None)]
    frame = spark.createDataFrame(odd, schema).withColumn("lang_pred", F.lit(7))
    found = identify(frame, train).collect()
    assert sorted(r.lang_pred for r in found if r.doc_id in (1, 2, 3)) == ["und"] * 3
    assert {r.lang_pred for r in found if r.doc_id not in (1, 2, 3)} <= set(SYLLABLES)
    assert identify(frame.limit(0), train).count() == 0
    assert {r.lang_pred for r in identify(frame, train.limit(0)).collect()} == {"und"}


def test_language_held_out_accuracy(spark):
    found = queries.op1_language_id(spark, TABLES).join(queries.documents(spark, TABLES), "doc_id").filter("held_out")
    right = found.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0]
    assert right >= 0.97


def test_quality_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{TABLES}/labels.parquet")
    found = queries.op2_quality(spark, TABLES).join(labels, "doc_id").filter("held_out")
    right = found.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert right >= 0.95


def test_scoring_is_one_expression_without_python_or_shuffle(spark):
    rules = Rules(0.5, (((("upper_share", True, 0.4), ("log_words", False, 3.0)), -2.0),))
    frame = score_quality(queries.documents(spark, TABLES), rules)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and plan.count("FileScan") == 1


def test_quality_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "x" * 200_000), (None, "plain words here"), (5, "a b"), (5, "a b")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("stats", F.lit(1))
    none = fit_rules(frame, spark.createDataFrame([], "doc_id long, quality int"))
    assert none.score is not None and none.weighted == ()
    ones = fit_rules(frame, spark.createDataFrame([(5, 1), (1, None), (77, 0), (2, 9), (None, 1)], "doc_id long, quality int"))
    found = score_quality(frame, ones).collect()
    assert len(found) == 6 and {round(r.score, 6) for r in found} == {round((2 + 1) / (2 + 2), 6)}
    assert {r.predicted for r in found} == {1}
    assert score_quality(frame.limit(0), ones).count() == 0


def test_rules_fire_as_written(spark):
    frame = spark.createDataFrame([(1, "AAAA BB"), (2, "aaaa bb")], "doc_id long, text string")
    rules = Rules(0.0, (((("upper_share", True, 0.5),), -3.0),))
    found = {r.doc_id: r.score for r in score_quality(frame, rules).collect()}
    assert found[2] == pytest.approx(0.5) and found[1] == pytest.approx(1 / (1 + 2.718281828459045**3))
