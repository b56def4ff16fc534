"""Connected components of a link table, on Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import written


def components(links: DataFrame) -> DataFrame:
    """id and component, the smallest id reachable, for every id in links (a long, b long).

    Every id that has a smaller neighbour points to its smallest one; pointers only go down,
    so they form trees, which are flattened by pointer doubling. Links between the roots are
    what is left for the next round. Self-links and null ends are ignored; repeated links
    count once; no links give an empty result. Each round's tables are written and read
    again, so that a join can split a hot root's rows over tasks.
    """
    left = _between(links.select(F.col("a").alias("x"), F.col("b").alias("y")))
    left = written(left, "links")
    labels = None
    while not left.isEmpty():
        roots = _flattened(written(left.groupBy("high").agg(F.min("low").alias("root")).withColumnRenamed("high", "id"), "trees"))
        if labels is None:
            ids = left.select(F.col("high").alias("id")).unionByName(left.select(F.col("low").alias("id"))).distinct()
            labels = ids.join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("component"))
        else:
            moved = roots.withColumnRenamed("id", "component")
            labels = labels.join(moved, "component", "left").select("id", F.coalesce("root", "component").alias("component"))
        labels = written(labels, "labels")
        high = left.join(roots.withColumnRenamed("id", "high"), "high", "left").select(F.coalesce("root", "high").alias("x"), "low")
        both = high.join(roots.withColumnRenamed("id", "low"), "low", "left").select("x", F.coalesce("root", "low").alias("y"))
        left = written(_between(both), "links")
    if labels is None:
        return links.sparkSession.createDataFrame([], "id long, component long")
    return labels


def _between(pairs: DataFrame) -> DataFrame:
    kept = pairs.where("x != y")
    return kept.select(F.greatest("x", "y").alias("high"), F.least("x", "y").alias("low")).distinct()


def _flattened(trees: DataFrame) -> DataFrame:
    """trees (id, root) with every root followed to the top."""
    while True:
        above = trees.select(F.col("id").alias("root"), F.col("root").alias("above"))
        if trees.join(above, "root", "left_semi").isEmpty():
            return trees
        trees = written(trees.join(above, "root", "left").select("id", F.coalesce("above", "root").alias("root")), "trees")
