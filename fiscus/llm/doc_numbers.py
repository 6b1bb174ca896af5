"""Places in texts as one 64-bit number each, for documents with any ids and texts of any length.

A place is the number of its document and a position in its text. How many bits the position takes follows from the
longest text. Ids are numbered by their distance from the smallest one if that leaves them
room, otherwise by their rank. Either way the order of numbers is that of the ids.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fiscus.shared import stored


@dataclass(frozen=True)
class Places:
    """How places are put together; ``ranks`` maps numbers to ids where they are ranks."""

    bits: int
    least: int
    ranks: DataFrame | None

    def place(self, number: Column, position: Column) -> Column:
        return F.shiftleft(number, self.bits) + position

    def number(self, place: Column) -> Column:
        return F.shiftright(place, self.bits)

    def position(self, place: Column) -> Column:
        return place.bitwiseAND(F.lit(2**self.bits - 1)).cast("int")

    def with_ids(self, rows: DataFrame, number_col: str) -> DataFrame:
        """Rows with the ids in place of the numbers in a column."""
        if self.ranks is None:
            return rows.withColumn(number_col, F.col(number_col) + F.lit(self.least))
        names = self.ranks.select(F.col("number").alias(number_col), F.col("doc").alias("own_doc"))
        others = [c for c in rows.columns if c != number_col]
        return rows.join(names, number_col).select(F.col("own_doc").alias(number_col), *others)


def dense_ranks(ids: DataFrame) -> DataFrame:
    """``doc`` and ``number``, from 0 in ascending order; ranges are ranked on their own and shifted by what lies before."""
    spark = ids.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = stored(
        ids.distinct().repartitionByRange(parts, "doc").withColumn("part", F.spark_partition_id()), "id-ranges"
    )
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    sizes = ranges.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("ahead"))
    within = F.row_number().over(Window.partitionBy("part").orderBy("doc")) - 1
    ranked = ranges.join(F.broadcast(sizes), "part").select("doc", (F.col("ahead") + within).alias("number"))
    return stored(ranked, "id-ranks")


def numbered(texts: DataFrame) -> tuple[DataFrame, Places]:
    """``number`` and ``text`` of ``texts`` (``doc``, unique and not null, and ``text``), and how to read their places."""
    low, high, longest = texts.agg(F.min("doc"), F.max("doc"), F.max(F.length("text"))).first()
    bits = max(8, (longest or 0).bit_length())
    if low is None:
        low = high = 0
    if high - low < 2 ** (62 - bits):
        places = Places(bits, low, None)
        return texts.select((F.col("doc") - F.lit(low)).alias("number"), "text"), places
    ranks = dense_ranks(texts.select("doc"))
    if ranks.count() >= 2 ** (63 - bits):
        raise ValueError("places of these texts do not fit 64 bits")
    return stored(texts.join(ranks, "doc").select("number", "text"), "numbered-texts"), Places(bits, 0, ranks)
