"""Repeated word runs, wherever they lie: winnowed anchors propose, full windows decide.

A text is its words in order, whatever white space is between them, so lines
play no part. A window is a run of ``WINDOW`` words. All windows that occur before (in a smaller
document id, or further ahead in the same document) are repeats:

1. The least hash of the runs of ``ANCHOR`` words in a window is its anchor: equal windows have
   equal anchors. Windows in a row with one anchor are a stretch. Only windows whose anchor has
   several stretches, or occurs twice in one, can be repeats.
2. Where all stretches of an anchor are equal, a stretch stands for its windows, as they can only be repeated together;
   otherwise its windows are looked at one by one. Either are grouped by two 64-bit hashes, and all but the
   first place of each are repeats.
3. Overlapping repeats are one span. Spans that follow each other in both
   documents, with some other words between them, are one span if their shingles are similar enough.

Every word that goes has an equal one further ahead that stays, or lies between words of that kind.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiscus.llm.doc_numbers import numbered
from fiscus.llm.marks import IdMarks
from fiscus.llm.signatures import _STEP, SHINGLE_WORDS, WORDS_AT_ONCE, mixed, word_hashes
from fiscus.shared import scratch, small_batches, stored

WINDOW = 20
ANCHOR = 8
ANCHORS_IN_WINDOW = WINDOW - ANCHOR + 1
SPANS = "array<struct<start:int,end:int>>"
_PROOF_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _powers(step: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""

    def series(base: int) -> np.ndarray:
        factors = np.full(count, base, np.uint64)
        factors[0] = 1
        return np.cumprod(factors)

    return series(step), series(pow(step, -1, 2**64))


_usual_powers = lru_cache(_powers)


class SpanHashes:
    """A hash of any span of words by the difference of two running sums, so that its length costs nothing."""

    def __init__(self, words: np.ndarray, step: np.uint64):
        usual = 2 * WORDS_AT_ONCE
        powers, self.inverses = (
            _usual_powers(int(step), usual) if len(words) < usual else _powers(int(step), len(words) + 1)
        )
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * powers[: len(words)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        lengths = (ends - starts).astype(np.uint64)
        return mixed((self.sums[ends] - self.sums[starts]) * self.inverses[starts] + lengths * _STEP)

    def of_width(self, width: int) -> np.ndarray:
        """Of all spans of ``width`` words."""
        count = len(self.sums) - width
        return mixed((self.sums[width:] - self.sums[:count]) * self.inverses[:count] + np.uint64(width * int(_STEP) % 2**64))


def _sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    done = 1
    while done < width:
        more = min(done, width - done)
        values = best(values[:-more], values[more:])
        done += more
    return values


class Stretches:
    """The stretches of some texts, which are strung together: where they start, their windows, their anchor.

    ``plain`` is false where the anchor may occur twice in a stretch; only there can a window be repeated within it.
    """

    def __init__(self, texts: list[list[bytes]]):
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_ends = np.cumsum(lengths)
        self.words = word_hashes(chain.from_iterable(texts), int(lengths.sum()))
        self.proofs = SpanHashes(self.words, _PROOF_STEP)
        runs = self.proofs.of_width(ANCHOR)
        least = _sliding(runs, ANCHORS_IN_WINDOW, np.minimum)
        left = np.repeat(self.text_ends, lengths)[: len(least)] - np.arange(len(least))
        least[left < WINDOW] = 0  # windows across texts are none
        at = np.flatnonzero(left >= WINDOW)
        anchors = least[at]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (np.diff(at) != 1) | (anchors[1:] != anchors[:-1])
        first = np.flatnonzero(fresh)
        self.starts, self.anchors = at[first], anchors[first]
        self.counts = np.diff(first, append=len(at))
        self.ends = self.starts + self.counts + WINDOW - 1
        self.plain = self.counts <= ANCHORS_IN_WINDOW
        # Two places of one anchor in a stretch follow each other among all places of anchors.
        pad = np.zeros(ANCHORS_IN_WINDOW - 1, np.uint64)
        places = np.flatnonzero(_sliding(np.concatenate([pad, least, pad]), ANCHORS_IN_WINDOW, np.maximum) == runs)
        again = runs[places[1:]] == runs[places[:-1]]
        if again.any():
            before = np.concatenate([[0], np.cumsum(again)])
            low = np.searchsorted(places, self.starts)
            high = np.searchsorted(places, self.ends - ANCHOR, "right") - 1
            self.plain &= before[high] == before[low]

    def chosen(self, which: np.ndarray, loose: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and numbers of windows of some stretches; of ``loose`` ones each window for itself."""
        starts, counts = self.starts[which], self.counts[which]
        times = np.where(loose, counts, 1)
        return counted_up(starts, times), np.repeat(np.where(loose, 1, counts), times)

    def hashes(self, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = starts + counts + WINDOW - 1
        return SpanHashes(self.words, _STEP).of(starts, ends).view(np.int64), self.proofs.of(starts, ends).view(np.int64)

    def places(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The text (from 0) and the word in it."""
        texts = np.searchsorted(self.text_ends, starts, "right")
        return texts, starts - np.concatenate([[0], self.text_ends])[texts]


def counted_up(starts: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Each start, and as many numbers from it on as ``times`` says."""
    return np.repeat(starts - np.cumsum(times) + times, times) + np.arange(times.sum())


def stretches_of(texts: list[str]) -> Iterator[tuple[int, Stretches]]:
    """Stretches of many texts, and the first text of each group; groups have ``WORDS_AT_ONCE`` words, a longer text is one of its own."""
    group: list[list[bytes]] = []
    first = waiting = 0
    for n, text in enumerate(texts):
        group.append(text.encode().lower().split())
        waiting += len(group[-1])
        if waiting >= WORDS_AT_ONCE:
            yield first, Stretches(group)
            group, first, waiting = [], n + 1, 0
    if waiting >= WINDOW:
        yield first, Stretches(group)


def anchor_stretches(texts: DataFrame) -> DataFrame:
    """``key`` (the anchor) and ``proof`` of every stretch; those that are not plain have a second row with another proof."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, own in stretches_of(batch.column(0).to_pylist()):
                proofs = own.proofs.of(own.starts, own.ends).view(np.int64)
                columns = (
                    np.concatenate([own.anchors.view(np.int64), own.anchors[~own.plain].view(np.int64)]),
                    np.concatenate([proofs, ~proofs[~own.plain]]),
                )
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "proof"])

    return texts.select("text").mapInArrow(found, "key long, proof long")


def likely_repeats(texts: DataFrame, bits: int, shared: DataFrame) -> DataFrame:
    """``key``, ``proof``, ``place`` and ``n`` (number of windows) of stretches or windows whose anchor is in ``shared``.

    ``place`` is document number and word in one number. An anchor that is ``mixed`` has its windows one by one, here as everywhere.
    """
    marks = IdMarks(shared, "key")
    mixed_up = IdMarks(shared.filter("mixed"), "key")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(0).to_numpy(zero_copy_only=False)
            for first, own in stretches_of(batch.column(1).to_pylist()):
                which = np.flatnonzero(marks.hits(own.anchors.view(np.int64)))
                if not len(which):
                    continue
                starts, counts = own.chosen(which, mixed_up.hits(own.anchors[which].view(np.int64)))
                doc, word = own.places(starts)
                columns = (*own.hashes(starts, counts), (numbers[first + doc] << bits) + word, counts)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "proof", "place", "n"])

    return texts.select("number", "text").mapInArrow(found, "key long, proof long, place long, n long")


def joined_spans(starts: np.ndarray, firsts: np.ndarray, percent: int, bits: int = 24) -> list[tuple[int, int]]:
    """Spans of words (from, to before) that repeated windows cover; ``starts`` ascend, ``firsts`` are the first places.

    ``bits`` of a place are its word, the others its document. A *run* is a row of windows whose first places follow each other
    in the same way. The words between two runs go as well if there are few, if both runs follow each other in one
    document further ahead, and if the shingles of the whole are similar enough there; shingles are counted by their places.
    """
    shifts = firsts - starts
    cuts = np.flatnonzero((np.diff(starts) > WINDOW) | (np.diff(shifts) != 0)) + 1
    spans: list[list[int]] = []
    begun = there = shared = end_there = 0  # of the passage that the last run belongs to: where it starts, here and there
    for part in np.split(np.arange(len(starts)), cuts):
        start, end, ahead = int(starts[part[0]]), int(starts[part[-1]]) + WINDOW, int(firsts[part[0]])
        own = end - start - SHINGLE_WORDS + 1
        last = spans[-1][1] if spans else 0
        if spans and last < start <= last + WINDOW and ahead >> bits == there >> bits and ahead >= end_there:
            whole, other = end - begun - SHINGLE_WORDS + 1, ahead + end - start - there - SHINGLE_WORDS + 1
            if 100 * (shared + own) >= percent * (whole + other - shared - own):
                spans[-1][1] = end
                shared, end_there = shared + own, ahead + end - start
                continue
        if spans and start <= last:
            spans[-1][1] = end
        else:
            spans.append([start, end])
        begun, there, shared, end_there = start, ahead, own, ahead + end - start
    return [(start, end) for start, end in spans]


def repeated_spans(plain: DataFrame, percent: int) -> DataFrame:
    """``doc``, ``spans`` of words to remove and ``holders``, the ids of the documents that hold their first places.

    ``plain`` has ``doc`` (unique, not null) and ``text`` (not null); documents without repeats are left out.
    """
    with scratch(plain.sparkSession), small_batches(plain.sparkSession):
        texts, numbers = numbered(plain)
        bits = numbers.bits
        shared = stored(
            anchor_stretches(texts).groupBy("key")
            .agg(F.count("*").alias("n"), F.min("proof").alias("low"), F.max("proof").alias("high"))
            .filter("n > 1").select("key", F.expr("low <> high").alias("mixed")),
            "shared-anchors",
        )
        likely = stored(likely_repeats(texts, bits, shared), "likely-repeats")
        # Stored before the join, so that a hot window is dealt out over several tasks (skewed sort-merge join).
        firsts = stored(
            likely.groupBy("key", "proof").agg(F.min("place").alias("first"), F.max("place").alias("last"))
            .filter("first <> last").select("key", "proof", "first"),
            "first-places",
        )
        repeats = likely.join(firsts.hint("merge"), ["key", "proof"]).filter("place <> first")
        listed = repeats.groupBy(F.shiftright("place", bits).alias("doc")).agg(
            F.sort_array(F.collect_list(F.struct("place", "first", "n"))).alias("parts")
        ).select("doc", *(F.col("parts")[name].alias(name) for name in ("place", "first", "n")))

        def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                spans, holders = [], []
                for parts in zip(*batch.columns[1:]):
                    places, first, times = (x.values.to_numpy(zero_copy_only=False) for x in parts)
                    places, first = counted_up(places, times), counted_up(first, times)
                    found = joined_spans(places & (2**bits - 1), first, percent, bits)
                    spans.append([{"start": s, "end": e} for s, e in found])
                    holders.append(np.unique(first >> bits).tolist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                     pa.array(holders, pa.list_(pa.int64()))],
                    names=["doc", "spans", "holders"],
                )

        spans = stored(listed.mapInArrow(merged, f"doc long, spans {SPANS}, holders array<long>"), "repeated-spans")
        named = numbers.with_ids(spans.select("doc", F.explode("holders").alias("holder")), "holder")
        holders = named.groupBy("doc").agg(F.sort_array(F.collect_set("holder")).alias("holders"))
        return stored(
            numbers.with_ids(spans.drop("holders").join(holders, "doc"), "doc").select("doc", "spans", "holders"),
            "removed-spans",
            outlives=True,
        )


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without spans of its words; of the white space around one, the part with a line break stays."""
    words = [m.span() for m in _WORD.finditer(text)]
    left, at = [], 0
    for start, end in spans:
        begin, stop = words[start][0], words[end - 1][1]
        before, after = (words[start - 1][1] if start else 0), (words[end][0] if end < len(words) else len(text))
        if end < len(words) and (not start or ("\n" in text[stop:after] and "\n" not in text[before:begin])):
            left.append(text[at:before])
            at = stop if start else after
        elif end < len(words):
            left.append(text[at:begin])
            at = after
        else:
            left.append(text[at:before])
            at = stop if start else len(text)
    return "".join(left) + text[at:]


def without_spans(text: Column, spans: Column) -> Column:
    @F.arrow_udf("string")
    def cut_all(texts: pa.Array, found: pa.Array) -> pa.Array:
        left = [
            t if t is None else cut(t, [(s["start"], s["end"]) for s in x]) for t, x in zip(texts.to_pylist(), found.to_pylist())
        ]
        return pa.array(left, pa.string())

    return cut_all(text, spans)
