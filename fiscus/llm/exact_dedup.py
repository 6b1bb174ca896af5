"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by the SHA-256 digest of the
normalised text. A batch is reduced to one row per digest, digests that the
index already holds are found by a sort-merge join on the buckets, and the rest
is appended. Only digests, identifiers and counts move; texts never do.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscus.shared import new_folder, stored

DIGEST = "text_digest"


def normalised_text(text: Column) -> Column:
    """Runs of ASCII white space become one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised_text(text), 256))


@dataclass(frozen=True)
class DigestIndex:
    """Digests seen so far, with the document that stays for each.

    ``path`` outlives the session: opening it again registers the same files.
    """

    spark: SparkSession
    table: str
    path: str
    buckets: int

    @staticmethod
    def open(spark: SparkSession, path: str, buckets: int) -> DigestIndex:
        """Open the index in ``path`` or start an empty one; keep ``buckets`` the same for a path."""
        table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {table} (text_digest BINARY, keep_id BIGINT) USING PARQUET "
            f"CLUSTERED BY (text_digest) SORTED BY (text_digest) INTO {int(buckets)} BUCKETS "
            f"LOCATION '{path}'"
        )
        return DigestIndex(spark, table, path, int(buckets))

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def close(self) -> None:
        """Take the table out of the catalog; its files stay and can be opened again."""
        self.spark.sql(f"DROP TABLE {self.table}")

    def append(self, groups: DataFrame) -> None:
        """Add digests that the index does not hold; one file per bucket."""
        (
            groups.select(DIGEST, "keep_id")
            .repartition(self.buckets, DIGEST)
            .sortWithinPartitions(DIGEST)
            .write.insertInto(self.table)
        )


def deduplicate(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows of ``docs`` with ``text_digest``, ``keep_id``, ``group_size`` and ``kept``; the index grows.

    Of equal texts in the batch the smallest id stays, unless the index
    already holds the text: then its document stays and the whole group goes.
    Null texts count as empty. Rows that repeat an id and its text are one
    document and share its verdict. A null id stays only if no row of its
    group has an id. An empty table gives an empty result. Input columns of
    the four result names are replaced.

    A digest may hold any share of the rows: grouping combines on the map side, and the
    join back deals a hot digest out over several tasks (skewed sort-merge join).
    """
    plain = docs.drop(DIGEST, "keep_id", "group_size", "kept").withColumn(DIGEST, text_digest(F.col(f"`{text_col}`")))
    is_new = next(name for name in ("is_new", *(f"is_new_{n}" for n in range(len(docs.columns)))) if name not in docs.columns)
    batch = plain.groupBy(DIGEST).agg(F.min(id_col).alias("batch_id"), F.count("*").alias("group_size"))
    known = index.rows().select(DIGEST, F.col("keep_id").alias("known_id"))
    new = batch.join(known.hint("merge"), DIGEST, "left_anti").select(
        DIGEST, F.col("batch_id").alias("keep_id"), "group_size", F.lit(True).alias(is_new)
    )
    old = batch.join(known.hint("merge"), DIGEST).select(
        DIGEST, F.col("known_id").alias("keep_id"), "group_size", F.lit(False).alias(is_new)
    )
    # Written before the index grows, or a second evaluation would find its own rows in it.
    groups = stored(new.unionByName(old), "digest-groups")
    index.append(groups.filter(F.col(is_new)))
    return (
        plain.join(groups.hint("merge"), DIGEST)
        .withColumn("kept", F.col(is_new) & F.col(f"`{id_col}`").eqNullSafe(F.col("keep_id")))
        .drop(is_new)
    )


def deduplicate_batch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deduplicate against a new, empty index in the shared folder."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = DigestIndex.open(spark, new_folder(spark, "digest-index"), buckets)
    try:
        return deduplicate(docs, index, id_col, text_col)
    finally:
        index.close()
