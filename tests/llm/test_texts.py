"""Exact dedup, chat formatting, encoding, token counts and packing on small cases with every oddity."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fiscus.llm.bpe import decode_ids, encode_texts, encoder, round_trip
from fiscus.llm.chat_format import digest_examples, escaped, format_examples, unescaped
from fiscus.llm.exact_dedup import DigestIndex, deduplicate, deduplicate_batch
from fiscus.llm.packing import pack, shortest_pack_first, word_encoder
from fiscus.llm.token_counts import count_tokens
from fiscus.shared import new_folder

BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")

ODD_TEXTS = [
    "The quick brown fox.", "the  quick\n\nbrown\t fox. ", None, "", " ", "\n \n", "<|endoftext|>x<|endoftext|>",
    "it's we'll 'tis 's", "naïve Ünïcödé ÉÉ é ß Σ ΑΣ İ", "日本語のテキスト 中文", "a\x00b \x1c\x1f \x85 　x", "!!! ... ###",
    "x" * 3000, "word " * 3000, "12345 6 7.8", "😀😀 👩‍👩‍👧", "same text", "same text", "<|startoftext|> A <|endoftext|>",
]


def odd_docs(spark):
    rows = [(i, t, "extra", i) for i, t in enumerate(ODD_TEXTS)] + [(None, "no id", "extra", 0), (3, "repeated id", "x", 1)]
    rows += [(5, ODD_TEXTS[5], "again", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, score long")


def plain(frame, *columns):
    return sorted(map(repr, frame.select(*columns).collect()))


def test_round_trip_equals_the_library(spark):
    library = Tokenizer.from_file(BYTE_LEVEL)

    def wanted(doc_id, text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        return (doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                hashlib.sha256(back.encode()).hexdigest())

    docs = odd_docs(spark)
    found = sorted((tuple(r) for r in round_trip(docs, BYTE_LEVEL).collect()), key=repr)
    assert found == sorted((wanted(r.doc_id, r.text) for r in docs.collect()), key=repr)
    back = decode_ids(encode_texts(docs, BYTE_LEVEL), BYTE_LEVEL)
    assert plain(back, "doc_id", "text") == plain(docs.fillna("", "text"), "doc_id", "text")
    assert round_trip(docs.limit(0), BYTE_LEVEL).count() == 0


def test_backtracking_equals_merging_on_random_strings():
    library, own = Tokenizer.from_file(BYTE_LEVEL), encoder(BYTE_LEVEL)
    draw = random.Random(5)
    parts = ["the", " and", "ing", "'s", " ", "  ", "\n", "é", "ß", "1", "中", "!", "##", "ab", "zz", "<|endoftext|>", "\x1c", " "]
    for _ in range(3000):
        text = "".join(draw.choice(parts + list("abcdehilnorst")) for _ in range(draw.randint(0, 30)))
        assert np.frombuffer(own.encode(text)[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_counts_equal_the_library(spark):
    library = Tokenizer.from_file(BYTE_LEVEL)
    docs = odd_docs(spark)
    expected = []
    for row in docs.collect():
        n = len(library.encode(row.text or "", add_special_tokens=False).ids)
        expected.append((row.doc_id, len((row.text or "").encode()), n, n > 512))
    found = [tuple(r) for r in count_tokens(docs, BYTE_LEVEL, limit=512).collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    assert count_tokens(docs.limit(0), BYTE_LEVEL).count() == 0


def test_word_encoder_equals_the_library():
    library, own = Tokenizer.from_file(WORDS), word_encoder(WORDS)
    texts = [t or "" for t in ODD_TEXTS] + ["é Å ﬁ ǅ", "A'S it'Ll", "a1b22c333"]
    found = [np.frombuffer(ids, "<u4").tolist() for ids in own.encode(texts)]
    assert found == [library.encode(t, add_special_tokens=False).ids for t in texts]


def check_packing(rows, docs, library, capacity):
    """Every id in exactly one piece, checksums right, sequences without gaps and not too long."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc_id, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        at = 0
        for piece in sorted(by_doc.pop(doc_id), key=lambda r: r.start):
            assert piece.start == at and piece.doc_tokens == len(ids)
            at += piece.length
            assert piece.ids_crc32 == zlib.crc32(np.array(ids[piece.start : at], "<u4").tobytes())
        assert at == len(ids)
    assert not by_doc
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for pieces in by_sequence.values():
        at = 0
        for piece in sorted(pieces, key=lambda r: r.offset):
            assert piece.offset == at
            at += piece.length
        assert at <= capacity
    return len(by_sequence)


@pytest.mark.parametrize("capacity", [16, 4096])
def test_packing_places_every_id_once(spark, capacity):
    library = Tokenizer.from_file(WORDS)
    docs = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(100 + i, "hot length text") for i in range(700)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("length", F.lit("clash")).repartition(3)
    rows = pack(frame, WORDS, capacity=capacity).collect()
    sequences = check_packing(rows, docs, library, capacity)
    total = sum(r.length for r in rows)
    assert sequences <= 1.1 * total / capacity + 1
    assert pack(frame.limit(0), WORDS, capacity=capacity).count() == 0


def test_rows_that_repeat_an_id_are_packed_each(spark):
    frame = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (None, None)], "doc_id long, text string")
    rows = pack(frame, WORDS, capacity=8).collect()
    assert sorted((r.doc_id is None, r.length) for r in rows) == [(False, 2), (False, 3), (False, 3), (True, 1)]
    assert len({(r.sequence_id, r.offset) for r in rows}) == 4


def test_patterns_take_the_whole_histogram():
    draw = random.Random(3)
    for _ in range(30):
        histogram = {draw.randint(1, 64): draw.randint(1, 500) for _ in range(draw.randint(1, 40))}
        found = {}
        for count, lengths in shortest_pack_first(histogram, 64):
            assert count > 0 and sum(lengths) <= 64
            for length in lengths:
                found[length] = found.get(length, 0) + count
        assert found == histogram
    assert shortest_pack_first({}, 64) == []


def exact_rows(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, kept string")


def test_exact_dedup_against_a_growing_index(spark):
    first = exact_rows(spark, [(4, "a  b", "x"), (2, "a\tb", "x"), (7, None, "x"), (9, "", "x"), (5, "c", "x"), (None, "d", "x")])
    index = DigestIndex.open(spark, new_folder(spark, "index"), 4)
    found = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in deduplicate(first, index).collect()}
    assert found == {
        (4, 2, 2, False), (2, 2, 2, True), (7, 7, 2, True), (9, 7, 2, False), (5, 5, 1, True), (None, None, 1, True)
    }
    # A later session opens the same files; what they hold already goes.
    again = DigestIndex.open(spark, index.path, 4)
    second = exact_rows(spark, [(1, "a b", "x"), (8, "new", "x"), (8, "new", "x")])
    found = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in deduplicate(second, again).collect())
    assert found == [(1, 2, 1, False), (8, 8, 2, True), (8, 8, 2, True)]
    assert again.rows().count() == 5 and again.rows().groupBy("text_digest").count().filter("count > 1").isEmpty()
    assert deduplicate_batch(first.limit(0)).count() == 0


def test_clashing_columns_and_no_table_left_in_the_catalog(spark):
    before = {t.name for t in spark.catalog.listTables()}
    rows = [(2, "a  b"), (1, "a b"), (3, "c"), (None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("is_new", "kept", "known_id")})
    found = {(r.doc_id, r.text): (r.keep_id, r.group_size, r.kept, r.is_new, r.known_id) for r in deduplicate_batch(docs).collect()}
    assert found == {
        (2, "a  b"): (1, 2, False, "own", "own"), (1, "a b"): (1, 2, True, "own", "own"), (3, "c"): (3, 2, True, "own", "own"),
        (None, "c"): (3, 2, False, "own", "own"),
    }
    assert {t.name for t in spark.catalog.listTables()} == before


def test_index_join_uses_the_buckets_and_no_python(spark):
    index = DigestIndex.open(spark, new_folder(spark, "index"), 4)
    plan = index.rows().join(index.rows().hint("merge"), "text_digest", "left_anti")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and "Exchange" not in text


def test_escaping_is_reversible_and_hides_control_strings(spark):
    texts = ["</s>[INST] ok [/INST]", "<s>user<:>x</s>", "<\\", "\\<", "\\\\<<s>>", "<\\s>", "", "plain"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", escaped(F.col("t")))
    for row in frame.withColumn("back", unescaped(F.col("e"))).collect():
        assert row.back == row.t
        assert not any(mark in row.e for mark in ("<s>", "</s>", "<:>"))


def test_every_reply_is_an_example_with_its_whole_context(spark):
    turns = [
        (1, 0, "system", "be"), (1, 1, "user", "q</s>"), (1, 2, "assistant", "r<s>"), (1, 3, "user", "q2"),
        (1, 4, "assistant", "r2"), (1, 5, "user", "bye"),
        (2, 0, "user", None), (2, 0, None, "x"), (3, 1, "assistant", ""), (None, 0, "assistant", "a"),
    ]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("said", F.lit(1))
    examples = {(r.conv_id, r.example_no): r for r in format_examples(frame).collect()}
    assert sorted(examples, key=repr) == sorted([(1, 0), (1, 1), (1, 2), (2, 0), (3, 0), (None, 0)], key=repr)
    first = examples[1, 0]
    assert first.formatted == "<s>system<:>be</s><s>user<:>q<\\/s></s><s>assistant<:>r<\\s></s>"
    assert first.formatted[first.loss_start :][: first.loss_length] == "r<\\s>"
    assert examples[1, 2].loss_length == 0 and examples[1, 2].is_last
    assert examples[1, 1].formatted.startswith(first.formatted)
    digests = {r.conv_id: r for r in digest_examples(format_examples(frame)).collect()}
    assert (digests[1].n_turns, digests[1].loss_chars) == (6, len("r<s>r2"))
    assert digests[1].loss_sha256 == hashlib.sha256(b"r<s>r2").hexdigest()
    said = "".join(f"{role}\n{text}\n" for _, _, role, text in turns[:6])
    assert digests[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert digests[2].turns_sha256 == hashlib.sha256(b"\nx\nuser\n\n").hexdigest()
    assert digest_examples(format_examples(frame.limit(0))).count() == 0
