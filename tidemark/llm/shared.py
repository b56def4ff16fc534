"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_folders: list[str] = []  # of the scratch blocks that are open


def shared_dir(spark: SparkSession) -> str:
    """A folder in the one named by spark.checkpoint.dir.

    Where the session names none, a local master gets a temporary folder and any other an
    error, since executors would write to disks that nobody else reads.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        context_dir = spark.sparkContext.getCheckpointDir()
        if context_dir is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
            context_dir = spark.sparkContext.getCheckpointDir()
        named = context_dir
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return f"{named.rstrip('/')}/tidemark-{spark.sparkContext.applicationId}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again.

    The lineage ends there: a lost executor costs a re-read and no recomputation, and a
    value that depends on the order in which shuffle blocks arrive is fixed once.
    """
    spark = df.sparkSession
    path = f"{_folders[-1] if _folders else shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder for the tables written inside the block; it is deleted at the end, so results have to be written elsewhere by then."""
    folder = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    _folders.append(folder)
    try:
        yield folder
    finally:
        _folders.pop()
        _delete(spark, folder)


def release(spark: SparkSession) -> None:
    """Delete every table this session wrote; call it when their readers are done."""
    _delete(spark, shared_dir(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df, written, with one more column that numbers its rows; the numbers have holes and are fixed once written."""
    return written(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


def running_sums(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """df, written, with the sums of columns over all rows before each row in the given order; sums: column to name.

    Rows are sorted into ranges, each range sums its own rows, and one row for each range gives
    what the ranges before it hold, so no task sees more than a range. Rows that are equal in
    the order follow each other in any order.
    """
    at, part = fresh(df, "_at", "_part")
    df = written(df.orderBy(*order).withColumn(at, F.monotonically_increasing_id()).withColumn(part, F.shiftright(at, 33)), "ranges")
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    totals = df.groupBy(part).agg(*[F.sum(c).alias(n) for c, n in sums.items()])
    totals = totals.select(F.col(part).alias("_of"), *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}") for n in sums.values()])
    within = Window.partitionBy(part).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    found = df.join(F.broadcast(totals), F.col(part) == F.col("_of"))
    for column, name in sums.items():
        found = found.withColumn(name, F.col(f"_{name}") + F.coalesce(F.sum(column).over(within), F.lit(0)))
    return written(found.drop(at, part, "_of", *[f"_{n}" for n in sums.values()]), "sums")


def labelled_texts(documents: DataFrame, chosen: DataFrame, text_col: str) -> DataFrame:
    """doc_id, text, label and stands_for of the chosen ids (doc_id, label, stands_for) that documents hold.

    Of rows that repeat an id the one with the smallest hash of its text teaches. chosen is a bounded sample.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    found = documents.select("doc_id", text).join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    one = found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("row"))
    return one.select("doc_id", "row.text").join(F.broadcast(chosen), "doc_id")


def label_sample(known: DataFrame, size: int) -> DataFrame:
    """doc_id, label and stands_for of at most size rows of known (doc_id, label 0 or 1), at most half of them of each label.

    The rows are chosen by a hash of their ids; stands_for is the number of rows of known with
    the same label for each chosen one, so that sums weighted by it have the shares of known.
    """
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    parts = []
    for label in (0, 1):
        n = counts.get(label, 0)
        part = known.where(F.col("label") == label).select("doc_id", F.col("label").cast("long").alias("label"))
        part = part.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size // 2)
        parts.append(part.withColumn("stands_for", F.lit(n / max(1, min(n, size // 2)))))
    return parts[0].unionByName(parts[1])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row that can be hashed; orders repeated rows that differ elsewhere."""
    return F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and kind != "variant"])
