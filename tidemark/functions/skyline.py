"""Skylines of many points: rows that no other row dominates, found without a task that sees all of them.

A row a dominates b if a <= b + eps everywhere and a < b - eps somewhere. Points are sorted along
a Z-curve of their scaled coordinates and cut into blocks, so a block fills a small box. Of two
blocks the corners tell whether the first can dominate any row of the second, and whether it
surely dominates all of them; only blocks between these meet, one after the other, in a stream
that holds two blocks at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.order import numbered_in_order
from tidemark.sources.tables import stored

FEW = 16_384  # dominators that are sent to all tasks at once
BLOCK = 4096  # rows of a block
STEP = 512  # rows compared with each other at a time
GROUP = 64  # blocks of dominators that one stream takes
BITS, AXES = 8, 7  # of the Z-curve


def minimal(points: np.ndarray) -> np.ndarray:
    """Places of the points that no other point is at most equal to everywhere, one of equal points; by ascending sums."""
    order = np.lexsort((*points.T[::-1], points.sum(axis=1)))
    kept: list[np.ndarray] = []
    for a in range(0, len(order), STEP):
        own = order[a : a + STEP]
        for block in kept:  # whoever dominates has the smaller sum, or comes first of equal ones
            own = own[~_below(points[block], points[own]).any(axis=1)]
        own = own[~np.tril(_below(points[own], points[own]), -1).any(axis=1)]
        if len(own):
            kept.append(own)
    return np.concatenate(kept) if kept else np.zeros(0, int)


def _below(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For each q (rows) and p (columns) whether p is at most q everywhere."""
    found = p[:, 0] <= q[:, :1]
    for k in range(1, p.shape[1]):
        found &= p[:, k] <= q[:, k : k + 1]
    return found


def dominated(points: np.ndarray, dominators: np.ndarray, eps: float) -> np.ndarray:
    """Whether each point is dominated by one of the dominators."""
    found = np.zeros(len(points), bool)
    for a in range(0, len(dominators), STEP):
        p, left = dominators[a : a + STEP], np.flatnonzero(~found)
        for b in range(0, len(left), STEP):
            rows = left[b : b + STEP]
            near = _below(p, points[rows] + eps)
            some = np.flatnonzero(near.any(axis=1))
            if len(some):
                less = np.zeros((len(some), len(p)), bool)
                for k in range(points.shape[1]):
                    less |= p[:, k] < points[rows[some], k : k + 1] - eps
                found[rows[some]] = (near[some] & less).any(axis=1)
    return found


def _matrix(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])


def local_fronts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The minimal points of each partition of rows, without repeats within one."""

    def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((0, len(columns)))
        for batch in batches:
            points = np.vstack([found, _matrix(batch, columns)])
            found = points[minimal(points)]
        for a in range(0, len(found), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found[a : a + (1 << 16)].T], columns)

    return rows.select(*columns).mapInArrow(survivors, ", ".join(f"`{c}` double" for c in columns))


def undominated(rows: DataFrame, columns: list[str], eps: float = 1e-9, few: int | None = None) -> DataFrame:
    """The rows (id and columns, complete doubles) that no other row dominates.

    Who is dominated at all is dominated by a minimal point, so rows are compared with these alone:
    with the ones that partitions and then blocks leave. Up to FEW (or few) of them are sent to all
    tasks; more of them meet the rows block by block. Both give the same rows.
    """
    few = FEW if few is None else few
    fronts = stored(local_fronts(rows, columns), "fronts")
    if fronts.limit(few + 1).count() <= few:
        points = fronts.toPandas().to_numpy(float)
        best = points[minimal(points)]

        def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(~dominated(_matrix(batch, columns), best, eps)))

        return rows.mapInArrow(left, rows.schema)
    distinct = fronts.distinct().withColumn("id", F.monotonically_increasing_id()).transform(stored, "fronts")
    best = _left(distinct, distinct, columns, 0.0)
    return _left(rows, best, columns, eps)


def _curve(df: DataFrame, columns: list[str], extent: dict[str, float]) -> Column:
    """Place on the Z-curve: BITS bits of each of the first AXES coordinates, interleaved."""
    cells = []
    for c in columns[:AXES]:
        low, high = extent[f"low_{c}"] or 0.0, extent[f"high_{c}"] or 0.0
        width = (high - low) or 1.0
        cells.append(F.least(F.greatest(((F.col(c) - low) / width * (1 << BITS)).cast("long"), F.lit(0)), F.lit((1 << BITS) - 1)))
    place = F.lit(0).cast("long")
    for bit in range(BITS):
        for axis, cell in enumerate(cells):
            place = place.bitwiseOR(F.shiftleft(F.shiftright(cell, bit).bitwiseAND(F.lit(1)).cast("long"), bit * len(cells) + axis))
    return place


def _blocks(df: DataFrame, columns: list[str], extent: dict[str, float]) -> DataFrame:
    """block, low and high corners and points (id and columns), stored; BLOCK rows along the Z-curve to a block."""
    placed = numbered_in_order(df.select("id", *columns).withColumn("_z", _curve(df, columns, extent)), ["_z", "id"], "_nth")
    rows = F.collect_list(F.struct("id", *columns)).alias("points")
    corners = [F.array(*[f(c) for c in columns]).alias(n) for n, f in (("low", F.min), ("high", F.max))]
    return placed.groupBy(F.expr(f"_nth div {BLOCK}").alias("block")).agg(*corners, rows).transform(stored, "blocks")


def _left(rows: DataFrame, dominators: DataFrame, columns: list[str], eps: float) -> DataFrame:
    """rows without those that a dominator dominates; both have id and columns. Boxes are one row for each BLOCK rows."""
    spark = rows.sparkSession
    extent = rows.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("low", F.min), ("high", F.max))]).first().asDict()
    theirs = _blocks(dominators, columns, extent)
    ours = theirs if rows is dominators else _blocks(rows, columns, extent)
    boxes = theirs.select("block", "low", "high").toPandas()
    shared = spark.sparkContext.broadcast((boxes["block"].to_numpy(), np.array(boxes["low"].tolist()), np.array(boxes["high"].tolist())))

    def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """block, with (a block of dominators that may dominate some of its rows), and whether one surely dominates all."""
        numbers, lows, highs = shared.value
        for batch in batches:
            for block, low, high in zip(*[batch.column(c).to_pylist() for c in ("block", "low", "high")]):
                low, high = np.array(low), np.array(high)
                gone = bool(((highs <= low + eps).all(axis=1) & (highs < low - eps).any(axis=1)).any())
                near = numbers[(lows <= high + eps).all(axis=1) & (lows < high - eps).any(axis=1)] if not gone else numbers[:0]
                width = len(near) + gone
                yield pa.RecordBatch.from_arrays([pa.array([block] * width, pa.int64()), pa.array([*near.tolist(), *[None] * gone], pa.int64())], ["block", "with"])

    pairs = ours.select("block", "low", "high").mapInArrow(meetings, "block long, with long").transform(stored, "meetings")
    id_type = dict(ours.dtypes)["points"].split("id:")[1].split(",")[0]
    gone = pairs.where(F.col("with").isNull()).select("block").distinct()
    group = F.expr(f"`with` div {GROUP}").alias("group")
    streams = pairs.where(F.col("with").isNotNull()).select("block", "with", group)
    own = streams.select("block", "group").distinct().join(ours.select("block", "points"), "block").select("block", "group", F.lit(-1).cast("long").alias("with"), "points")
    other = streams.join(theirs.select(F.col("block").alias("with"), "points"), "with").select("block", "group", "with", "points")
    dealt = own.unionByName(other).repartition("block", "group").sortWithinPartitions("block", "group", "with")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, points = None, None, None
        for batch in batches:
            kind = batch.schema.field("points").type.value_type.field("id").type
            for i in range(batch.num_rows):
                values = batch.column("points").slice(i, 1).flatten()
                matrix = np.column_stack([values.field(c).to_numpy(zero_copy_only=False) for c in columns])
                here = batch.column("block")[i].as_py(), batch.column("group")[i].as_py()
                if batch.column("with")[i].as_py() < 0:
                    key, ids, points = here, values.field("id"), matrix
                elif here == key and len(points):
                    lost = dominated(points, matrix, eps)
                    if lost.any():
                        yield pa.RecordBatch.from_arrays([ids.filter(pa.array(lost)).cast(kind)], ["id"])
                        ids, points = ids.filter(pa.array(~lost)), points[~lost]

    lost = dealt.mapInArrow(compared, f"id {id_type}")
    lost = lost.unionByName(gone.join(ours, "block").select(F.explode("points.id").alias("id"))).distinct().withColumnRenamed("id", "_lost")
    return rows.join(lost, F.col("id") == F.col("_lost"), "left_anti")
