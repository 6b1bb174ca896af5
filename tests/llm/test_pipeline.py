"""Every stage of the pipeline against brute force on its own input, and the whole of it."""

from __future__ import annotations

import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from fiscus.shared import stored
from tests.llm import reference_results
from tests.llm.test_texts import check_packing

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def after(spark):
    """Rows before the first stage and after each one."""
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    found = {"": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, TABLES), name)
        found[name] = docs.collect()
    return found


def kept(after, before, stage):
    """The rows that stayed, unchanged, by id."""
    rows = {r.doc_id: r for r in after[before]}
    left = {r.doc_id: r for r in after[stage]}
    assert len(left) == len(after[stage])
    assert all(rows[i] == r for i, r in left.items())
    return set(left)


def test_stages_and_their_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality", "exact_dedup", "near_dedup", "substring_dedup", "packing"
    ]


def test_quality_rejects_what_is_labelled_low_and_keeps_the_rest(spark, after):
    left = kept(after, "", "quality")
    labels = spark.read.parquet(f"{TABLES}/labels.parquet").collect()
    assert sum((r.doc_id in left) == (r.quality == 1) for r in labels) >= 0.95 * len(labels)


def test_exact_copies_go(after):
    first = {}
    for r in sorted(after["quality"], key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r.doc_id)
    assert kept(after, "quality", "exact_dedup") == set(first.values())


def test_near_copies_go(after):
    groups = reference_results.groups({r.doc_id: r.text for r in after["exact_dedup"]}, corpus_pipeline.NEAR_COPIES.percent)
    assert kept(after, "exact_dedup", "near_dedup") == set(groups.values())


def test_passages_go(after):
    rows = {r.doc_id: r for r in after["near_dedup"]}
    lines = {
        (i << 24) + n: line
        for i, r in rows.items() for n, line in enumerate(r.text.split("\n")) if len(line.split()) >= 20
    }
    groups = reference_results.groups(lines, 80)
    left = {
        i: "\n".join(
            line for n, line in enumerate(r.text.split("\n")) if groups.get((i << 24) + n, (i << 24) + n) == (i << 24) + n
        )
        for i, r in rows.items()
    }
    gone = reference_results.removed_words(left)
    for r in after["substring_dedup"]:
        own = rows[r.doc_id]
        assert r.text.split() == [w for n, w in enumerate(left[r.doc_id].split()) if n not in gone[r.doc_id]]
        assert gone[r.doc_id] or r.text == left[r.doc_id]
        assert (r.lang, r.source) == (own.lang, own.source)
        assert r.n_chars == (own.n_chars if r.text == own.text else len(r.text))
    assert {r.doc_id for r in after["substring_dedup"]} == set(rows)


def test_all_that_is_left_is_packed(after):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = [(r.doc_id, r.text) for r in after["substring_dedup"]]
    check_packing(after["packing"], docs, library, 4096)


def test_run_gives_the_last_stage(spark, after):
    found = corpus_pipeline.run(spark, TABLES)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, after["packing"]))


def test_odd_documents_pass_all_stages(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", None, 0), (2, "", "en", None, 0), (None, "some words", "en", "s", 10),
            (4, "long " * 20000, "en", "s", 100000), (5, "plain words here.", None, "s", 17)]
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for table in (docs, docs.limit(0)):
        at = table
        for name, stage in corpus_pipeline.STAGES:
            at = stored(stage(spark, at, str(tmp_path)), name)
            if name != "packing":
                assert at.columns == docs.columns
    assert at.count() == 0
