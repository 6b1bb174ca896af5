"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscus.llm.bpe import round_trip
from fiscus.llm.chat_format import digest_examples, format_examples
from fiscus.llm.conversation_repair import damaged, repair_conversations
from fiscus.llm.exact_dedup import deduplicate_batch
from fiscus.llm.importance import resample
from fiscus.llm.language_id import identify
from fiscus.llm.near_dedup import near_duplicates
from fiscus.llm.packing import pack
from fiscus.llm.paragraph_dedup import remove_repeats
from fiscus.llm.quality import fit_rules, score_quality
from fiscus.llm.secret_scan import digest_secrets, scan_secrets
from fiscus.llm.token_counts import count_tokens
from fiscus.llm.topk import top_k
from fiscus.llm.twins import OP11_SQL, OP12_SQL, OP13_SQL

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out() -> Column:
    """A quarter of the documents, by a checksum of the id, is kept from training; null ids are not among them."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, docs.filter(F.col("doc_id").isNotNull() & ~held_out())).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score"
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out())
    return score_quality(docs, fit_rules(docs, labels)).select(
        "doc_id", held_out().alias("held_out"), "score", "predicted"
    )


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return deduplicate_batch(docs).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("text_digest")).alias("text_sha256")
    )


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(control).alias("text"),
    )
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return digest_examples(format_examples(turns.unionByName(added)))


def op8_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=2)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_secrets(scan_secrets(documents(spark, sf_dir)))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair_conversations(damaged(turns), times_col="times")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = resample(documents(spark, sf_dir), target, percent=10, least_words=20, buckets=10_000, longest=1, seed="2024")
    return found.select("doc_id", "n_features", "weight", "score", "rank")


OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(
   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
   lambda x: x <> '') AS w FROM documents),
 l AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
   ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS l FROM w),
 n AS (SELECT doc_id, len(l) AS n FROM l),
 s AS MATERIALIZED (SELECT doc_id, hash(s) AS s FROM (SELECT doc_id, unnest(l) AS s FROM l)),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.s = b.s AND a.doc_id <> b.doc_id
   GROUP BY ALL),
 e AS MATERIALIZED (SELECT p.a, p.b FROM p JOIN n AS x ON x.doc_id = p.a JOIN n AS y ON y.doc_id = p.b
   WHERE 100 * c >= 85 * (x.n + y.n - c)),
 r AS (SELECT doc_id AS id, doc_id AS c FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id)
SELECT n.doc_id, CAST(any_value(n.n) AS BIGINT) AS n_shingles, min(r.c) AS component_id, n.doc_id = min(r.c) AS kept
FROM n JOIN r ON r.id = n.doc_id GROUP BY n.doc_id
"""

OP5_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
   AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(v.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
 g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256
FROM d JOIN g USING (t)
"""

OP7_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
 w AS (SELECT *, 10 + length(role) + length(text) + length(regexp_replace(role || text, '[^<\\]', '', 'g')) AS chars,
   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
   count(*) OVER (PARTITION BY conv_id) AS n FROM t),
 c AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS upto FROM w)
SELECT conv_id, count(*) AS n_turns,
 sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(upto) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


def queries() -> dict[str, Query]:
    return {
        "op1_language_id": op1_language_id,
        "op2_quality": op2_quality,
        "op3_near_dedup": op3_near_dedup,
        "op4_bpe_round_trip": op4_bpe_round_trip,
        "op5_exact_top_k": op5_exact_top_k,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_chat_format": op7_chat_format,
        "op8_paragraph_dedup": op8_paragraph_dedup,
        "op9_packing": op9_packing,
        "op10_token_counts": op10_token_counts,
        "op11_secret_scan": op11_secret_scan,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_importance_resampling": op13_importance_resampling,
    }


def statements() -> dict[str, str]:
    return {
        "op3_near_dedup": OP3_SQL,
        "op5_exact_top_k": OP5_SQL,
        "op6_exact_dedup": OP6_SQL,
        "op7_chat_format": OP7_SQL,
        "op11_secret_scan": OP11_SQL,
        "op12_conversation_repair": OP12_SQL,
        "op13_importance_resampling": OP13_SQL,
    }
