"""Resampling against a plain computation over all words, and exact ranks over any number of ranges."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fiscus.llm import importance
from fiscus.llm.importance import WordRuns, drawn, resample


def features(text, longest):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plain(docs, target, percent, least, buckets, longest):
    def totals(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t, longest)[1])

    s, t = totals(text for _, text in docs), totals(target)
    all_s, all_t = s.total(), t.total()
    gain = [
        math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets)))) for b in range(buckets)
    ]
    rows = []
    for n, (i, text) in enumerate(docs):
        words, found = features(text, longest)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in found)
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(words), len(found), weight, score, None])
    able = [r for r in rows if r[0] is not None and r[1] >= least]
    for place, r in enumerate(sorted(able, key=lambda r: (-r[4], r[0]))[: percent * len(able) // 100], 1):
        r[5] = place
    return sorted(map(tuple, rows), key=repr)


def texts(count, seed):
    draw = random.Random(seed)
    words = ["Über", "x1", "naïve", "A-b", "日本", "don't", "and", "or"] + [f"w{n}" for n in range(60)]
    return [draw.choice([" ", "\x00", ", "]).join(draw.choices(words, k=draw.randint(0, 60))) for _ in range(count)]


@pytest.mark.parametrize(("longest", "chunk"), [(1, 1 << 20), (3, 1 << 20), (3, 40)])
def test_runs_of_words_carry_checksums_on(monkeypatch, longest, chunk):
    monkeypatch.setattr(importance, "CHUNK_BYTES", chunk)
    for text in texts(60, 2):
        found, words = Counter(), 0
        for n, part in WordRuns(longest).counters(text.encode()):
            words += n
            found += part
        assert words == len(features(text, longest)[0])
        assert found == Counter(zlib.crc32(f.encode()) for f in features(text, longest)[1])


@pytest.mark.parametrize("longest", [1, 2])
def test_rows_equal_the_plain_computation(spark, longest):
    docs = list(enumerate(texts(300, 3))) + [(5, "again " * 50), (5, "again " * 50), (None, "no id " * 30), (900, None), (901, "")]
    docs.append((902, "long Text " * 200_000))
    target = texts(20, 4) + [None]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rank", F.lit("x")).withColumn("id", F.lit(1))
    other = spark.createDataFrame([(t,) for t in target], "text string").withColumn("bucket", F.lit(0))
    found = resample(frame.repartition(5), other, percent=30, buckets=500, longest=longest).collect()
    assert sorted(map(tuple, found), key=repr) == plain(docs, target, 30, 20, 500, longest)


def test_empty_tables(spark):
    frame = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert resample(frame.limit(0), frame).count() == 0
    assert tuple(resample(frame, frame.limit(0), least_words=1).first()) == plain([(1, "a b")], [], 10, 1, 10_000, 1)[0]


def test_ranks_over_many_ties_and_one_hot_row(spark):
    scores = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("id"),
        F.when(F.col("id") % 3 == 0, 50).otherwise(F.pmod(F.xxhash64("id"), F.lit(90))).cast("long").alias("score"),
    )
    rows = [tuple(r) for r in scores.collect()]
    found = drawn(scores.repartition(7), F.lit(True), 55).collect()
    wanted = sorted(rows, key=lambda r: (-r[1], r[0]))[: 4000 * 55 // 100]
    ranked = sorted((r.rank, r.id, r.score) for r in found if r.rank is not None)
    assert [(i, s) for _, i, s in ranked] == wanted and [n for n, *_ in ranked] == list(range(1, len(wanted) + 1))
    assert len(found) == 4000
