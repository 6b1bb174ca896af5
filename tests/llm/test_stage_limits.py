"""What single stages of the pipeline promise beyond the operators they use."""

from __future__ import annotations

import random

import corpus_pipeline
from tests.llm import reference_results
from tests.llm.test_similar import family, varied

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def test_near_copies_between_80_and_85_go(spark):
    draw = random.Random(12)
    texts = family(30, 90, 4, 21) + family(30, 150, 7, 22)
    base = [f"z{n}" for n in range(104)]
    texts += [" ".join(base), varied(base[:50] + ["u"] + base[51:80] + ["v"] + base[81:], 0, draw)]
    texts = dict(enumerate(texts))
    wanted = reference_results.groups(texts, 80)
    assert wanted != reference_results.groups(texts, 85)
    left = corpus_pipeline.drop_near_copies(spark, frame(spark, texts.items()), "").collect()
    assert sorted(r.doc_id for r in left) == sorted(set(wanted.values()))
