"""Operator 7: near-duplicate vectors by E8 lattice hashing.

Vectors are scaled to unit length and, per table, projected at random to eight dimensions,
shifted at random, and decoded to the nearest point of the lattice E8. A vector is entered in
the cell of that point and in the cells of the lattice points that come next nearest. Vectors
that share a cell of some table are compared by cosine in double precision.

Equal vectors of a label are one class with a multiplicity. Each cell names the member whose
cells are largest in sum as its pivot, and the classes that share a pivot form a group, so that
a cluster which shares many cells is one group and its vectors are moved once. A group's members
are dealt into blocks of bounded size that span a grid; a task gets the vectors of one cell of
it, two blocks or one, and compares them by matrix product, so a vector is sent once for each
block of its group. Only counts and, for each vector, the smallest one it reaches leave a task, so a lattice cell that
holds a third of all vectors gives no pairs. A pair that meets in several groups is counted in
the first of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.shared import written
from tidemark.llm.textscan import mix64

THRESHOLD = 0.93
TABLES = 16
PROBES = 4  # lattice points beside the nearest
SCALE = 1.2
BLOCK = 4096  # members
ROWS = 512  # of a block that are compared at a time
SEED = 20240229


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates of 1 or -1, or all of a half with an even number of minus signs."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (1, -1):
                for b in (1, -1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for bits in range(256):
        signs = np.array([1 - 2 * (bits >> k & 1) for k in range(8)])
        if signs.prod() > 0:
            out.append(signs / 2)
    return np.array(out)


ROOTS = _roots()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest point with integer coordinates of even sum."""
    near = np.floor(x + 0.5)
    off = x - near
    worst = np.abs(off).argmax(axis=1)
    rows = np.flatnonzero(near.sum(axis=1) % 2)
    turn = np.where(off[rows, worst[rows]] >= 0, 1.0, -1.0)
    near[rows, worst[rows]] += turn
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest lattice point to each row: of the two cosets of D8 the nearer one."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(nearer[:, None], whole, half)


def _cell_keys(points: np.ndarray, table: int) -> np.ndarray:
    keys = np.full(points.shape[:-1], table + 1, np.uint64)
    doubled = (2 * points).astype(np.int64).astype(np.uint64)
    for i in range(8):
        keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + doubled[..., i])
    return keys


class LatticeIndex:
    """Projections and shifts of the tables for vectors of one dimension."""

    def __init__(self, dimension: int, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, seed: int = SEED):
        rng = np.random.default_rng([seed, dimension])
        self.planes = rng.standard_normal((tables, dimension, 8)) * scale
        self.shifts = rng.random((tables, 8)) * 2
        self.probes = probes

    def cells(self, units: np.ndarray) -> np.ndarray:
        """Keys of the cells of each unit vector: for each table the own one and the probed ones."""
        out = []
        for t, (plane, shift) in enumerate(zip(self.planes, self.shifts, strict=True)):
            x = units @ plane + shift
            own = nearest_e8(x)
            # of the neighbours own + root those with the largest product with the remainder are next
            nearest = np.argpartition(-(x - own) @ ROOTS.T, self.probes - 1, axis=1)[:, : self.probes]
            points = np.concatenate([own[:, None, :], own[:, None, :] + ROOTS[nearest]], axis=1)
            out.append(_cell_keys(points, t))
        return np.concatenate(out, axis=1).astype(np.int64)


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, label, the vector as bytes and a 128-bit name of these; null where it links with nothing.

    The bytes hold floats where these are exact, else doubles, and the first byte says which.
    """
    for batch in batches:
        column = batch.column(2)
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        # a null component is no number; -0.0 is 0.0
        flat = column.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False).astype(float) + 0.0
        offsets = offsets - offsets[0]
        with np.errstate(over="ignore", under="ignore", invalid="ignore"):
            short = flat.astype(np.float32)
            flags = (~np.isfinite(flat), flat != 0, short != flat)
        bad, some, long = (np.diff(np.concatenate([[0], np.cumsum(f)])[offsets]) > 0 for f in flags)
        usable = ~bad & some & batch.column(1).is_valid().to_numpy(zero_copy_only=False) & column.is_valid().to_numpy(zero_copy_only=False)
        vectors, names = [None] * len(column), [None] * len(column)
        for i in np.flatnonzero(usable).tolist():
            a, b = offsets[i], offsets[i + 1]
            data = b"d" + flat[a:b].tobytes() if long[i] else b"f" + short[a:b].tobytes()
            vectors[i], names[i] = data, hashlib.blake2b(data, digest_size=16).digest()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.binary()), pa.array(vectors, pa.binary())], ["id", "label", "name", "vector"])


def _units(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each dimension the places of its vectors and these, scaled to unit length."""
    offsets = np.frombuffer(vectors.buffers()[1], np.int32)[vectors.offset : vectors.offset + len(vectors) + 1]
    data = np.frombuffer(vectors.buffers()[2], np.uint8)
    sizes, wide = np.diff(offsets), data[offsets[:-1]] == ord("d")
    found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for size, long in sorted({*zip(sizes.tolist(), wide.tolist(), strict=True)}):
        rows = np.flatnonzero((sizes == size) & (wide == long))
        table = data[offsets[rows][:, None] + np.arange(1, size)].view(np.float64 if long else np.float32).astype(float)
        found.setdefault(table.shape[1], []).append((rows, table))
    for parts in found.values():
        rows, v = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        v = v / np.abs(v).max(axis=1, keepdims=True)
        yield rows, v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _indexed(tables: int, probes: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, LatticeIndex] = {}
        for batch in batches:
            keys: list = [None] * batch.num_rows
            for rows, units in _units(batch.column(1)):
                index = made.setdefault(units.shape[1], LatticeIndex(units.shape[1], tables, probes, scale))
                found = np.sort(index.cells(units), axis=1)
                fresh = np.ones(found.shape, bool)
                fresh[:, 1:] = found[:, 1:] != found[:, :-1]
                for i, k, f in zip(rows.tolist(), found, fresh, strict=True):
                    keys[i] = k[f]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.int64()))], ["node", "cells"])

    return run


class _Side:
    """The vectors of one dimension and one block of a cell."""

    def __init__(self, rows: np.ndarray, units: np.ndarray, members: pa.StructArray):
        self.units = units
        taken = members.take(pa.array(rows))
        self.nodes, self.copies = taken.field("node").to_numpy(), taken.field("copies").to_numpy()
        pivots = taken.field("pivots")
        self.pivots, self.owners = pivots.flatten().to_numpy(), np.repeat(np.arange(len(rows)), pivots.value_lengths().to_numpy())

    def earlier(self, pivot: int, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        on = (self.pivots < pivot) & (self.owners >= rows.start) & (self.owners < rows.stop)
        return self.pivots[on], self.owners[on] - rows.start


def _met_before(one: _Side, two: _Side, pivot: int, rows: slice) -> np.ndarray:
    """Whether rows of one and two share a pivot before this one, as a matrix product by columns of pivots."""
    whole = slice(0, len(two.nodes))
    sides = [one.earlier(pivot, rows), two.earlier(pivot, whole)]
    shared = np.intersect1d(sides[0][0], sides[1][0])
    out = np.zeros((rows.stop - rows.start, len(two.nodes)), bool)
    for a in range(0, len(shared), ROWS):
        tables = []
        for (pivots, owners), n in zip(sides, out.shape, strict=True):
            table = np.zeros((n, min(ROWS, len(shared) - a)), np.float32)
            at = np.searchsorted(shared[a : a + ROWS], pivots)
            on = np.flatnonzero(shared[a : a + ROWS][np.minimum(at, table.shape[1] - 1)] == pivots)
            table[owners[on], at[on]] = 1
            tables.append(table)
        out |= tables[0] @ tables[1].T > 0
    return out


def _join(labels: np.ndarray, first: int, second: int, linked: np.ndarray) -> None:
    """Give vertices that are linked one label, the smallest; rows of linked are vertices from first on, columns from second on."""
    for row in np.flatnonzero(linked.any(axis=1)).tolist():
        own = np.append(labels[second + np.flatnonzero(linked[row])], labels[first + row])
        least = own.min()
        if (own != least).any():
            hit = np.zeros(len(labels), bool)
            hit[own] = True
            labels[hit[labels]] = least


def _matched(threshold: float):
    """Counts of links of the members of each cell, and the smallest member that each reaches by its links; those of its second block are marked."""

    def compare(one: _Side, two: _Side, pivot: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(one.nodes)
        second = 0 if same else n
        nodes = one.nodes if same else np.concatenate([one.nodes, two.nodes])
        counts, labels = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
        for a in range(0, n, ROWS):
            rows = slice(a, min(a + ROWS, n))
            linked = one.units[rows] @ two.units.T >= threshold
            if same:
                linked[np.arange(len(linked)), np.arange(rows.start, rows.stop)] = False
            if not linked.any():
                continue
            linked &= ~_met_before(one, two, pivot, rows)  # such pairs were counted there
            counts[rows] += linked @ two.copies
            if not same:
                counts[n:] += linked.T @ one.copies[rows]
            _join(labels, a, second, linked)
        least = np.full(len(nodes), np.iinfo(np.int64).max)
        np.minimum.at(least, labels, nodes)
        hit = counts > 0
        return nodes[hit], counts[hit], least[labels[hit]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                pivot, same = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                members = batch.column(2).slice(row, 1).flatten()
                second = members.field("second").to_numpy(zero_copy_only=False)
                sides: list[dict[int, _Side]] = [{}, {}]
                for k in range(2):
                    block = members.filter(pa.array(second == bool(k)))
                    for rows, units in _units(block.field("vector")) if len(block) else ():
                        sides[k][units.shape[1]] = _Side(rows, units, block)
                for size, one in sides[0].items():
                    two = one if same else sides[1].get(size)
                    if two:
                        yield pa.RecordBatch.from_arrays([*map(pa.array, compare(one, two, pivot, same))], ["node", "links", "other"])

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE) -> DataFrame:
    """vec_id, n_links, component_id and kept, one row per input row.

    Vectors of equal labels are linked where a shared cell brings them together and their
    cosine is at least the threshold; none below it is linked. A vector that is null, empty,
    all zero or holds a null or non-finite component, or whose label is null, has no links and
    is its own component; so do vectors of different dimension to each other. A null id takes
    part in no group: its component_id is null and kept true. Rows that repeat an id and
    vector count as vectors of their own, and so do different vectors of one id. An empty
    table gives an empty result.
    """
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    usable = source.mapInArrow(_usable, "id long, label string, name binary, vector binary")
    rows = written(usable.select("id", "label", "name"), "names")
    first = usable.where("id is not null and vector is not null").groupBy("label", "name")
    classes = first.agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    # labels keep cells apart; the first id settles ties between pivots, so reruns agree
    cells = classes.select(F.struct("node", "label", "first").alias("node"), "vector").mapInArrow(_indexed(tables, probes, scale), "node struct<node: long, label: string, first: long>, cells array<long>")
    entries = cells.select("node.node", "node.first", F.explode("cells").alias("cell"), "node.label").select("node", "first", F.xxhash64("cell", "label").alias("cell"))
    entries = written(entries, "entries")
    crowded = entries.groupBy("cell").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = written(entries.join(crowded, "cell"), "members")
    weights = members.groupBy("node").agg(F.sum("size").alias("weight"))
    pivots = members.join(weights, "node").groupBy("cell").agg(F.max(F.struct("weight", "first", "node")).alias("top")).select("cell", F.col("top.node").alias("pivot"))
    stars = written(members.join(pivots, "cell").select("pivot", "node").distinct(), "stars")
    sizes = stars.groupBy("pivot").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    stars = written(stars.join(sizes, "pivot"), "groups")
    lists = stars.groupBy("node").agg(F.collect_list("pivot").alias("pivots"))  # no more than a node has cells
    blocks = F.ceil(F.col("size") / BLOCK)
    dealt = stars.select("node", "pivot", F.pmod(F.xxhash64("node"), blocks).alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    one, two = F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two")
    sent = dealt.select("node", "pivot", one, two, (F.col("block") > F.col("other")).alias("second"))
    full = sent.join(classes.join(lists, "node"), "node")
    # a cell of a group's grid holds about two blocks, however many members its group has
    cells = full.groupBy("label", "pivot", "one", "two").agg(F.collect_list(F.struct("second", "node", "copies", "vector", "pivots")).alias("members"))
    found = written(cells.select("pivot", F.expr("one = two").alias("same"), "members").mapInArrow(_matched(threshold), "node long, links long, other long"), "found")
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    grouped = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    known = classes.drop("vector").join(counted, "node", "left").join(grouped.withColumnRenamed("id", "node"), "node", "left")
    known = written(known.select("label", "name", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("top")), "known")
    tops = known.groupBy("top").agg(F.min("first").alias("component"))
    joined = rows.join(written(known.join(tops, "top").select("label", "name", "n_links", "component"), "components"), ["label", "name"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    out = joined.select("id", F.when(F.col("id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).alias("n_links"), component.alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
