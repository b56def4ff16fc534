"""Distances of all pairs of slices by blocks: a block of feature vectors meets a block of others in one Arrow row.

What is asked for is reduced where the distances are made, so no table of all pairs is kept: a
vector is sent once for each block it meets, and a task holds two blocks and their distances.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 256  # slices


def distance_matrix(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of the rows of a from those of b, added up feature by feature; those of METRICS."""
    out = np.zeros((len(a), len(b)))
    if metric == "cosine":
        norms = np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None]
        return np.maximum(1 - np.divide(a @ b.T, norms, out=out, where=norms > 0), 0.0)
    for k in range(a.shape[1]):
        off = a[:, k : k + 1] - b[:, k]
        if metric in ("euclidean", "l2", "sqeuclidean"):
            out += off * off
        elif metric == "chebyshev":
            np.maximum(out, np.abs(off), out=out)
        else:
            out += np.abs(off)
    return np.sqrt(out) if metric in ("euclidean", "l2") else out


def reduced(vectors: DataFrame, metric: str | None, kernel: Callable[[np.ndarray | None, dict, dict], dict], schema: str, within: str | None = None, size: int | None = None) -> DataFrame:
    """What kernel makes of every pair of blocks, as rows of schema.

    vectors: slice_id (whole numbers from 0), x and other columns. kernel gets the distances of a
    block's slices (rows) from another's (columns), and both blocks' columns as arrays; it returns
    the columns of schema. within: a column; only slices that agree in it meet. Without a metric
    the distances are left to the kernel, and x may differ in length. size: slices of a block.
    """
    keys = ["block"] + ([within] if within else [])
    names = [c for c in vectors.columns if c != "x"]
    block = F.expr(f"slice_id div {size or BLOCK}").cast("int").alias("block")
    blocks = vectors.select("*", block).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*names, "x"))).alias("rows"))
    places = blocks.select(*keys).withColumnRenamed("block", "to")
    if within:
        ways = places.groupBy(within).agg(F.collect_list("to").alias("to"))
        sent = blocks.withColumnRenamed("rows", "own").join(F.broadcast(ways), within).select(within, "own", F.explode("to").alias("block"))
    else:
        ways = places.agg(F.collect_list("to").alias("to"))  # one row: the numbers of blocks
        sent = blocks.withColumnRenamed("rows", "own").crossJoin(F.broadcast(ways)).select("own", F.explode("to").alias("block"))
    met = sent.join(blocks, keys).select("own", "rows")

    def columns(values: pa.StructArray) -> dict:
        found = {n: values.field(n).to_numpy(zero_copy_only=False) for n in names}
        x = values.field("x")
        flat = x.flatten().to_numpy(zero_copy_only=False).astype(float)
        found["x"] = flat.reshape(len(values), -1) if metric else np.split(flat, np.cumsum(x.value_lengths().to_numpy())[:-1])
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own, other = (columns(batch.column(c).slice(i, 1).flatten()) for c in ("own", "rows"))
                made = kernel(distance_matrix(own["x"], other["x"], metric) if metric else None, own, other)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in made.values()], list(made))

    return met.repartition(vectors.sparkSession.sparkContext.defaultParallelism * 2).mapInArrow(run, schema)


def sums_by_slice(vectors: DataFrame, metric: str, of: Callable[[np.ndarray], np.ndarray] = lambda d: d, within: str | None = None) -> DataFrame:
    """slice_id and s, the sum over all slices (that agree in within) of a function of the distance."""

    def kernel(d: np.ndarray, own: dict, other: dict) -> dict:
        return {"slice_id": other["slice_id"].astype(np.int32), "s": of(d).sum(axis=0)}

    return reduced(vectors, metric, kernel, "slice_id int, s double", within).groupBy("slice_id").agg(F.sum("s").alias("s"))


def pairs(vectors: DataFrame, metric: str) -> DataFrame:
    """i, j and d for all pairs of slices, for those who ask for all of them."""

    def kernel(d: np.ndarray, own: dict, other: dict) -> dict:
        i, j = np.repeat(own["slice_id"], d.shape[1]), np.tile(other["slice_id"], d.shape[0])
        return {"i": i.astype(np.int32), "j": j.astype(np.int32), "d": d.ravel()}

    return reduced(vectors.select("slice_id", "x"), metric, kernel, "i int, j int, d double")
