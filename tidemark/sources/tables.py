"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A folder in the one named by spark.checkpoint.dir.

    Where the session names none, a local master gets a temporary folder and any other an
    error, since executors would write to disks that nobody else reads.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        named = spark.sparkContext.getCheckpointDir()
    return f"{named.rstrip('/')}/tidemark-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written as a table and read again.

    What is built on it starts from a file scan, so it is computed once, plans stay short and
    a lost executor costs a re-read.
    """
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
