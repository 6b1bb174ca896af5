"""Near-duplicate documents by MinHash bands and odd sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscus.llm.near_links import near_groups
from fiscus.llm.signatures import Scheme

# 32 bands of 5 samples miss a pair at the limit once in 10^8; 160 samples in 512 bits.
DOCUMENTS = Scheme(percent=85, bands=32, rows=5, bits=512)


def near_duplicates(
    docs: DataFrame, scheme: Scheme = DOCUMENTS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col``, ``n_shingles``, ``component_id`` and ``kept`` of every row.

    Documents are linked if their sets of five-word shingles are similar
    enough; links carry on. Documents without words are alone. Null ids take no part and are kept, with a null
    component. Rows that repeat an id count as one document with the greatest
    text of that id; each row gets the result.
    An empty table gives an empty result; further columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = near_groups(docs.filter("id is not null"), scheme)
    alone = docs.filter("id is null").select(
        F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("n_shingles"),
        F.lit(None).cast("long").alias("component"),
    )
    return found.unionByName(alone).select(
        F.col("id").alias(id_col),
        "n_shingles",
        F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )
