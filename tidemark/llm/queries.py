"""The opN_ queries of this folder and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, bytebpe, dialogue, embdedup, exact, lexical, mixing, neardup, oracles, pii, placement, quality, tokencount, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and decisions of every document; labels learned outside the held-out third. Nulls, empty texts and repeated rows as quality.quality defines them."""
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document under word_bpe_49k; null counts as empty, repeated rows repeat (bpe.digests)."""
    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix by weights 5, 2, 1 takes of every document; null texts have size 0, a null source is the last one (mixing.mix_report)."""
    return mixing.mix_report(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, base spans and those of the field; null counts as empty, repeated rows repeat (pii.find)."""
    return pii.find(_table(spark, sf_dir, "documents"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents; null, empty and white texts link with nothing (neardup.near_groups)."""
    groups = neardup.near_groups(_table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and decisions of every document; labels learned outside the held-out fifth. Nulls and empty texts as toxicity.toxicity defines them."""
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all vectors within their labels; unusable vectors link with nothing (embdedup.near_vectors)."""
    return embdedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def op8_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of every document; a null id has slot 0, repeated ids share a shard (placement.place)."""
    return placement.place(_table(spark, sf_dir, "documents").select("doc_id")).select("doc_id", "slot", "shard")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts of all documents; null equals empty, the largest id stays (exact.exact_groups)."""
    groups = exact.exact_groups(_table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of every document under piece_bpe_32k; null and empty texts have none (tokencount.count_tokens)."""
    return tokencount.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after damage; nulls become one space (dialogue.repair_report)."""
    return dialogue.repair_report(_table(spark, sf_dir, "conversations"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for every benchmark item; texts without terms rank nowhere, equal scores by id (lexical.search)."""
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document under the ranks of byte_bpe_50k; null counts as empty, repeated rows repeat (bytebpe.digests)."""
    return bytebpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_bpe": op2_bpe,
    "op3_mixing": op3_mixing,
    "op4_pii": op4_pii,
    "op5_minhash": op5_minhash,
    "op6_toxicity": op6_toxicity,
    "op7_lattice": op7_lattice,
    "op8_placement": op8_placement,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_token_counts": op10_token_counts,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_lexical_search": op12_lexical_search,
    "op13_byte_bpe": op13_byte_bpe,
}


def _placement_sql() -> str:
    table = ",".join(map(str, placement.lookup_table()))
    return f"""
        WITH keyed AS (
            SELECT doc_id, coalesce(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT % {placement.TABLE_SIZE}, 0) AS slot
            FROM documents)
        SELECT doc_id, CAST(slot AS INTEGER) AS slot,
               'shard-' || lpad(CAST(([{table}])[slot + 1] AS VARCHAR), 3, '0') AS shard
        FROM keyed"""


ORACLES: dict[str, str] = {
    "op12_lexical_search": oracles.LEXICAL_SEARCH,
    "op11_conversation_repair": oracles.CONVERSATION_REPAIR,
    "op8_placement": _placement_sql(),
    "op9_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))""",
}
