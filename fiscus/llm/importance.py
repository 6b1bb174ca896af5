"""Resampling towards a target distribution by importance weights of hashed word runs.

1. *Count.* Texts stay bytes. One 256-byte table lower-cases A-Z and blanks all other ASCII characters than
   letters and digits; ``split`` then gives the words. The checksum of a run of words is that of its first words, carried on
   as the seed for the next one, so longer runs cost one step each. Counters reduce the checksums of a task to
   ``buckets`` numbers; only those are shuffled.
2. *Weigh.* The gain of a bucket compares its share in the target with that in the corpus. The table of gains
   has ``buckets`` numbers, whatever the corpus, and is sent to all tasks; each text sums the gains of its runs.
3. *Draw.* Gumbel noise from a digest of the identifier makes the highest scores a weighted sample without
   replacement. Scores are dealt out by ranges and ranked within them, so no task holds them all.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fiscus.shared import stored

_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz"
WORD_BYTES = bytes(b if b in _KEPT or b >= 0x80 else 0x20 for b in bytes(range(256)).lower())
CHUNK_BYTES = 1 << 20  # longer texts are cut into words piece by piece


@dataclass(frozen=True)
class WordRuns:
    """Features of a text: checksums of all runs of 1 to ``longest`` words."""

    longest: int = 1

    def words(self, data: bytes) -> Iterator[list[bytes]]:
        """The words of a text in order, in lists of bounded size."""
        clean = data.translate(WORD_BYTES)
        at = 0
        while at < len(clean):
            end = clean.find(b" ", at + CHUNK_BYTES)
            end = len(clean) if end < 0 else end
            yield clean[at:end].split()
            at = end

    def counters(self, data: bytes) -> Iterator[tuple[int, Counter]]:
        """For each list of words its length and how often each checksum occurs among the runs that end in it."""
        before: list[bytes] = []
        for words in self.words(data):
            found = Counter(map(zlib.crc32, words))
            if self.longest > 1:
                known = len(before)
                words_on = before + words
                seeds = list(map(zlib.crc32, words_on))
                for width in range(2, self.longest + 1):
                    seeds = [zlib.crc32(b" " + word, seed) for seed, word in zip(seeds, words_on[width - 1 :])]
                    found.update(seeds[max(0, known - width + 1) :])
                before = words_on[1 - self.longest :]
            yield len(words), found


def bucket_counts(texts: DataFrame, text_col: str, runs: WordRuns, buckets: int) -> list[int]:
    """How many features of all texts fall into each bucket."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [0] * buckets
        for batch in batches:
            for data in batch.column(0).to_pylist():
                for _, found in runs.counters(data):
                    for checksum, n in found.items():
                        totals[checksum % buckets] += n
        filled = [b for b in range(buckets) if totals[b]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(filled, pa.int32()), pa.array([totals[b] for b in filled], pa.int64())], names=["bucket", "n"]
        )

    data = texts.filter(F.col(text_col).isNotNull()).select(F.col(text_col).cast("binary"))
    found = data.mapInArrow(counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    totals = [0] * buckets
    for row in found.collect():  # at most one row per bucket
        totals[row.bucket] = row.n
    return totals


def bucket_gains(corpus: list[int], target: list[int]) -> list[int]:
    """Thousandths of the logarithm of the smoothed target share over the smoothed corpus share, rounded down."""
    buckets, in_corpus, in_target = len(corpus), float(sum(corpus)), float(sum(target))
    return [
        math.floor(1000 * math.log((t + 1.0) * (in_corpus + buckets) / ((s + 1.0) * (in_target + buckets))))
        for s, t in zip(corpus, target)
    ]


def weighed(docs: DataFrame, id_col: str, text_col: str, runs: WordRuns, gains: list[int]) -> DataFrame:
    """``id``, ``n_words``, ``n_features`` and ``weight`` of every row."""
    buckets = len(gains)

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, sums = [], [], []
            for data in batch.column(1).to_pylist():
                words = features = weight = 0
                for n, found in runs.counters(data or b""):
                    words += n
                    features += found.total()
                    weight += sum(gains[checksum % buckets] * times for checksum, times in found.items())
                n_words.append(words)
                n_features.append(features)
                sums.append(weight)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_features, sums))],
                names=["id", "n_words", "n_features", "weight"],
            )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("data")).mapInArrow(
        weights, "id long, n_words long, n_features long, weight long"
    )


def gumbel(ids: Column, seed: str) -> Column:
    """Thousandths of Gumbel noise, fixed by seed and identifier; null for a null identifier."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), ids.cast("string")), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 2.0**32
    return F.floor(-1000 * F.log(-F.log(uniform))).cast("long")


def drawn(scores: DataFrame, eligible: Column, percent: int) -> DataFrame:
    """``scores`` (``id``, ``score`` and more) with ``rank``: 1, 2, 3… for the drawn rows, null for the others.

    Drawn are the highest scores of the eligible rows, ``percent`` of their number rounded down, ties to the
    smaller identifier. Rows are dealt to ranges of the order; sizes of the ranges before a row and its
    place within its own range give its rank. Rows alike in all columns are interchangeable, and a number of
    their own keeps many of them from falling into one range.
    """
    spark = scores.sparkSession
    scores = stored(scores.withColumn("row", F.monotonically_increasing_id()).withColumn("eligible", eligible), "scores")
    most = percent * scores.filter("eligible").count() // 100
    order = [F.desc("score"), F.asc("id"), F.asc("row")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = stored(
        scores.filter("eligible").repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()),
        "score-ranges",
    )
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    sizes = ranges.groupBy("part").agg(F.count("*").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead")
    )
    placed = ranges.join(F.broadcast(sizes), "part")
    place = F.col("ahead") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    likely = placed.filter(F.col("ahead") < most).withColumn("place", place)
    none = F.lit(None).cast("long")
    columns = [c for c in scores.columns if c not in ("row", "eligible")]
    return (
        likely.select(*columns, F.when(F.col("place") <= most, F.col("place")).alias("rank"))
        .unionByName(placed.filter(F.col("ahead") >= most).select(*columns, none.alias("rank")))
        .unionByName(scores.filter("not eligible").select(*columns, none.alias("rank")))
    )


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    least_words: int = 20,
    buckets: int = 10_000,
    longest: int = 1,
    seed: str = "2024",
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
) -> DataFrame:
    """``id_col``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` of every row of ``docs``.

    ``rank`` is null where a row is not drawn. Null and empty texts have no words and the weight 0. Rows with
    fewer than ``least_words`` words are never drawn, nor rows with a null id, whose score is null.
    Rows that repeat an id have the same noise and count as documents each. Texts are read whole, very long ones
    piece by piece. An empty target or corpus is smoothed like any other; an empty table gives an
    empty result. Further columns are ignored.
    """
    runs = WordRuns(longest)
    gains = bucket_gains(
        bucket_counts(docs, text_col, runs, buckets), bucket_counts(target, target_col, runs, buckets)
    )
    scores = weighed(docs, id_col, text_col, runs, gains).withColumn("score", F.col("weight") + gumbel(F.col("id"), seed))
    eligible = (F.col("n_words") >= least_words) & F.col("id").isNotNull()
    return drawn(scores, eligible, percent).withColumnRenamed("id", id_col)
