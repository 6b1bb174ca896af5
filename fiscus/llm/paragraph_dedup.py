"""Removal of repeated passages: similar lines first, then repeated word runs wherever they lie.

A paragraph is a line of at least ``MIN_WORDS`` words. Paragraphs whose sets of
five-word shingles are similar enough are linked, whether in one document or in
several; of each connected group the first paragraph (smallest document id, then position) stays.

In the texts that this leaves, runs of words that occur before go (``passages.py``). They need not be
lines: they may lie inside a longer one or cross line breaks, and short lines belong to them as well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscus.llm.doc_numbers import numbered
from fiscus.llm.marks import IdMarks
from fiscus.llm.near_links import Units, near_groups
from fiscus.llm.passages import SPANS, repeated_spans, without_spans
from fiscus.llm.signatures import Scheme
from fiscus.shared import scratch, stored

MIN_WORDS = 20

# 12 bands of 4 samples: a pair at the limit is missed twice in a thousand, one at 0.9 practically never.
PARAGRAPHS = Scheme(percent=80, bands=12, rows=4, bits=256)
RESULTS = ("n_paragraphs", "n_removed", "removed", "removed_spans", "keep_doc_ids")


def lines_of_text(bits: int, least_bytes: int) -> Callable[[int, bytes], Iterator[tuple[int, bytes]]]:
    """Cuts a text into lines with their places (document number and position in ``bits``); shorter ones are left out."""

    def cut(number: int, data: bytes) -> Iterator[tuple[int, bytes]]:
        first = number << bits
        for position, line in enumerate(data.split(b"\n")):
            if len(line) >= least_bytes:
                yield first + position, line

    return cut


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc`` and ``text`` of the rows that take part."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").alias("text")).filter(
        "doc is not null and text is not null"
    )


def ids_repeat(plain: DataFrame) -> bool:
    return not plain.groupBy("doc").count().filter("count > 1").isEmpty()


def once_for_each_id(plain: DataFrame) -> DataFrame:
    """Rows that repeat an id with its text count once, those that repeat it with another text not at all."""
    mark = F.xxhash64("text")
    mixed_up = plain.groupBy("doc").agg(F.min(mark).alias("low"), F.max(mark).alias("high")).filter("low <> high")
    return plain.join(mixed_up, "doc", "left_anti").dropDuplicates(["doc"])


def free_name(docs: DataFrame, name: str) -> str:
    """The name, or the name with a number, that is no column of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    return next(n for n in (name, *(f"{name}_{k}" for k in range(len(taken) + 1))) if n not in taken)


def remove_repeats(
    docs: DataFrame,
    scheme: Scheme = PARAGRAPHS,
    min_words: int = MIN_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """All rows of ``docs`` with the text left, ``n_paragraphs``, ``n_removed``, ``removed``, ``removed_spans`` and ``keep_doc_ids``.

    ``removed`` are positions of lines (from 0), ``removed_spans`` runs of words (from, to before) in
    the text without those lines, ``keep_doc_ids`` the distinct
    documents that hold what stays of them. A text that loses all its lines
    becomes empty, its row stays. Null texts stay null. Rows with a null id,
    and rows that repeat an id with another text, stay as they are; rows that repeat an id with its text
    are treated alike. Ids may be any 64-bit numbers and texts of any length. Columns of the five result names are
    replaced, all others stay, whatever their names. An empty table gives an empty result.

    The result reads two stored tables, of the texts without lines and of the spans; all others are deleted.
    """
    docs = docs.drop(*RESULTS)
    doc_id = F.col(f"`{id_col}`").cast("long")
    text = F.col(f"`{text_col}`")
    plain = _plain(docs, id_col, text_col)
    repeating = ids_repeat(plain)
    changes = repeated_lines(once_for_each_id(plain) if repeating else plain, scheme, min_words)
    lines = F.split(text, "\n")
    left = F.array_join(F.filter(lines, lambda line, at: ~F.array_contains("removed", at)), "\n")
    key = free_name(docs, "changed_doc")
    changes = changes.withColumnRenamed("doc", key)
    counted = docs.withColumn("n_paragraphs", F.when(text.isNull(), 0).otherwise(F.size(lines)))
    # Only documents that may lose something are joined; the texts of the others are not shuffled.
    marked = IdMarks(changes, key).column(doc_id)
    joined = (
        counted.filter(marked)
        .join(changes, doc_id == F.col(key), "left")
        .withColumn(text_col, F.when(F.col("removed").isNotNull(), left).otherwise(text))
        .drop(key)
    )
    shorter = stored(
        joined.unionByName(counted.filter(~marked), allowMissingColumns=True)
        .withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
        .withColumn("keep_doc_ids", F.coalesce("keep_doc_ids", F.array().cast("array<long>")))
        .withColumn("n_removed", F.size("removed")),
        "shorter-texts",
    )
    key, spans_col, holders = (free_name(shorter, name) for name in ("cut_doc", "spans", "holders"))
    plain = _plain(shorter, id_col, text_col)
    spans = repeated_spans(once_for_each_id(plain) if repeating else plain, scheme.percent).toDF(key, spans_col, holders)
    marked = IdMarks(spans, key).column(doc_id)
    found = (
        shorter.filter(marked)
        .join(spans, doc_id == F.col(key), "left")
        .withColumn("removed_spans", F.coalesce(spans_col, F.array().cast(SPANS)))
        .withColumn("keep_doc_ids", F.array_sort(F.array_union("keep_doc_ids", F.coalesce(holders, F.array().cast("array<long>")))))
        .withColumn(text_col, F.when(F.col(spans_col).isNotNull(), without_spans(text, F.col("removed_spans"))).otherwise(text))
        .drop(key, spans_col, holders)
    )
    untouched = shorter.filter(~marked).withColumn("removed_spans", F.array().cast(SPANS))
    return found.unionByName(untouched)


def repeated_lines(plain: DataFrame, scheme: Scheme, min_words: int) -> DataFrame:
    """``doc``, ``removed`` (positions of lines) and ``keep_doc_ids`` of documents with similar lines further ahead."""
    with scratch(plain.sparkSession):
        texts, places = numbered(plain)
        # A line of that many words has a byte for each of them and for each space between.
        lines = lines_of_text(places.bits, 2 * min_words - 1)
        paragraphs = Units(texts.select(F.col("number").alias("id"), "text"), lines, min_words)
        groups = near_groups(paragraphs, scheme, unique_ids=True).filter("id <> component")
        gone = groups.select(
            places.number(F.col("id")).alias("doc"),
            places.position(F.col("id")).alias("position"),
            places.number(F.col("component")).alias("keep_doc_id"),
        )
        return stored(
            places.with_ids(places.with_ids(gone, "doc"), "keep_doc_id").groupBy("doc").agg(
                F.sort_array(F.collect_list("position")).alias("removed"),
                F.sort_array(F.collect_set("keep_doc_id")).alias("keep_doc_ids"),
            ),
            "removed-paragraphs",
            outlives=True,
        )
