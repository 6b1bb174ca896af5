"""A storage layout that spares the grouping its shuffle.

Rows are bucketed by the grouping keys other than the year, in folders by year, sorted by origin. A grouping by the
seven keys finds all rows of a key in one bucket and needs no exchange; a filter on the year leaves out folders, one on
the origin leaves out row groups.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscus.schema import KEYS, ORIGIN, YEAR
from fiscus.shared import setting
from fiscus.sources.fact import conform_fact, read_fact_table

BUCKET_KEYS = [name for name in KEYS if name != YEAR]


# A write task sorts about so many bytes of shuffled rows, whatever the size of the fact and of its largest key.
BYTES_OF_A_TASK = "8m"


def write_fact_table(fact: DataFrame, table: str, buckets: int, path: str | None = None) -> DataFrame:
    """Replace the catalog table by the fact in this layout and read it.

    Choose ``buckets`` so that a bucket of all years can be read by one task: about the bytes of the fact over 128 MB, or
    ``buckets_for`` its rows. Rows are dealt to the write tasks by year and bucket; adaptive execution cuts
    large shares into several tasks, with a file each, and joins small ones. So the memory of a write task is bounded. A
    key that holds a large share of all rows stays in one bucket, as bucketing demands; its rows are combined as they
    are read, so this costs time of one task, not memory. If that is too long, keep the plain layout: there such a key
    is combined in every task first.
    """
    rows = conform_fact(fact)
    bucket = F.pmod(F.hash(*[F.col(name) for name in BUCKET_KEYS]), F.lit(buckets))
    dealt = rows.withColumn("bucket", bucket).hint("rebalance", YEAR, "bucket").select(*rows.columns)
    writer = (
        dealt.write.mode("overwrite").format("parquet").partitionBy(YEAR)
        .bucketBy(buckets, *BUCKET_KEYS).sortBy(ORIGIN, *[name for name in BUCKET_KEYS if name != ORIGIN])
    )
    with setting(fact.sparkSession, "spark.sql.adaptive.advisoryPartitionSizeInBytes", BYTES_OF_A_TASK):
        (writer.option("path", path) if path else writer).saveAsTable(table)
    return read_fact_table(fact.sparkSession, table)


def buckets_for(rows: int, least: int = 8) -> int:
    """So many buckets that one holds about two million rows of all years, if the keys are spread evenly."""
    return max(least, math.ceil(rows / 2_000_000))
