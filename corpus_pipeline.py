"""From raw documents to packed training sequences.

Each stage works on all that the stage before kept, which is stored in the
shared folder in between: a lost executor costs the stage at hand only.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscus.llm.exact_dedup import deduplicate_batch
from fiscus.llm.marks import IdMarks
from fiscus.llm.near_dedup import near_duplicates
from fiscus.llm.packing import pack
from fiscus.llm.paragraph_dedup import remove_repeats
from fiscus.llm.quality import fit_rules, score_quality
from fiscus.llm.signatures import Scheme
from fiscus.shared import stored

REJECTED_BELOW = 0.5  # a document goes if low quality is likelier than high

# Near copies of the stage are similar from 0.8 on (op3 has a limit of its own); 40 bands of 4 samples miss a pair there
# about once in 10^9.
NEAR_COPIES = Scheme(percent=80, bands=40, rows=4, bits=512)

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble takes for good ones; it learns from ``labels``."""
    rules = fit_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, rules, REJECTED_BELOW).filter("predicted = 1").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, white space aside."""
    return deduplicate_batch(docs).filter("kept").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; documents without an id stay."""
    gone = stored(near_duplicates(docs, NEAR_COPIES).filter("not kept").select("doc_id"), "near-copies")
    # Only documents that may go are joined; the texts of the others are not shuffled.
    marked = IdMarks(gone, "doc_id").column(F.col("doc_id"))
    unsure = docs.filter(marked).join(gone, "doc_id", "left_anti")
    return unsure.select(*docs.columns).union(docs.filter(~marked))


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that another one, or the same one earlier, has already."""
    left = remove_repeats(docs)
    length = F.when((F.col("n_removed") > 0) | (F.size("removed_spans") > 0), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", length).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 4096 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", drop_passages),
    ("packing", pack_sequences),
]

# The quality stage fits a model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each to the stored result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
