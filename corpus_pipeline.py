"""The corpus pipeline: quality, exact duplicates, near duplicates, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents. Every
stage takes nulls in any column, repeated rows, extra columns and empty tables; what its
operator defines for them is said at the stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, exact, mixing, neardup, quality
from tidemark.llm.shared import scratch, shared_dir

#: None: SQL can express neither the field of the first stage nor the automaton of the last.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; its labels are those of sf_dir.

    Null, empty and white texts have the score of a text of good lines; repeated rows share a score.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays, of rows that repeat it one.

    Null equals empty; a null doc_id is the smallest.
    """
    return exact.drop_exact(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest doc_id stays, of rows that repeat it one.

    Null, empty and white texts and rows with null doc_ids stay.
    """
    return neardup.drop_near(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the shares of the mix: repeated, whole or in part, as their blocks are drawn.

    Null texts and texts without words are drawn never; a null source is a source of its own, the last.
    """
    return mixing.mixed_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the text they decode to; none and '' for null and empty texts."""
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json")).drop("text")


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; the result of the last.

    A stage's own tables are deleted once its result is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
