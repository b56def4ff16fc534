"""Search algorithms: generate and test, and four constructions.

Constructions work on the slice table: distances and errors are DataFrame jobs per step, and
what reaches the driver is one row per step or per selected slice, and for merging runs of
slices one row per slice.
"""

from __future__ import annotations

import heapq
from abc import ABC, abstractmethod
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.blocks import BLOCK, distance_matrix, reduced, sums_by_slice
from tidemark.functions.kernels import nonnegative_weights, simplex_weights
from tidemark.operators.combos import CombinationGenerator
from tidemark.operators.policies import ObjectiveSet, SelectionPolicy
from tidemark.plans.context import METRICS, ProblemContext
from tidemark.plans.experiment import RepSetResult, representatives_of
from tidemark.sources.tables import stored


class SearchAlgorithm(ABC):
    gives_weights = False

    @abstractmethod
    def find_selection(self, context: ProblemContext) -> RepSetResult: ...


def _labels(context: ProblemContext, ids: list[int]) -> tuple[str, ...]:
    names = {r["slice_id"]: r["slice_label"] for r in context.slices.where(F.col("slice_id").isin(ids)).collect()}
    return tuple(names[i] for i in ids)


def _weights(context: ProblemContext, pairs: list[tuple[int, float]]) -> DataFrame:
    rows = [(None, int(i), float(w)) for i, w in pairs]
    return context.slices.sparkSession.createDataFrame(rows, "slice_id int, rep_slice_id int, weight double")


class ObjectiveDrivenSearchAlgorithm(SearchAlgorithm):
    def __init__(self, objective_set: ObjectiveSet, selection_policy: SelectionPolicy):
        self.objective_set, self.selection_policy = objective_set, selection_policy


class ObjectiveDrivenCombinatorialSearchAlgorithm(ObjectiveDrivenSearchAlgorithm):
    """Scores every candidate of a generator in one job and lets a policy pick."""

    def __init__(self, objective_set: ObjectiveSet, selection_policy: SelectionPolicy, combination_generator: CombinationGenerator):
        super().__init__(objective_set, selection_policy)
        self.combination_generator = combination_generator
        self._scores: DataFrame | None = None

    def evaluations(self, context: ProblemContext) -> DataFrame:
        self.objective_set.prepare(context)
        return self.objective_set.evaluate_all(self.combination_generator.generate(context).persist())

    def get_all_scores(self) -> DataFrame:
        if self._scores is None:
            raise ValueError("find_selection has not run")
        return self._scores

    def find_selection(self, context):
        self._scores = stored(self.evaluations(context), "evaluations")
        best = self.selection_policy.select_best(self._scores, self.objective_set).first()
        if best is None:
            raise ValueError("there is no candidate")
        selection = _labels(context, list(best["slice_ids"]))
        scores = {n: best[n] for n in self.objective_set.specs}
        return RepSetResult(context, "subset", selection, scores, representatives_of(context, selection), None, {"evaluations_df": self._scores})


class KMedoidsSearch(SearchAlgorithm):
    """k medoids by distances of feature vectors, made block by block and never kept as a table of all pairs.

    method 'alternate' assigns slices and updates each medoid in turn; 'pam' makes the swap of
    a medoid with another slice that lowers the sum of distances most, as long as one does.
    A table holds each slice's distances to the medoids; a step computes those to new medoids only.
    init 'k-medoids++' draws starting medoids in proportion to squared distances, with
    random_state as seed; without one it takes the farthest slice each time, from the most
    central on. 'random' draws without weights, 'heuristic' takes the k most central slices
    and 'build' adds the slice that lowers the sum of distances most. Ties go to the smaller
    slice id. inertia is the sum of distances to the medoids; wcss is taken around centroids.
    """

    gives_weights = True

    def __init__(self, k: int, metric: str = "euclidean", method: str = "alternate", init: str = "k-medoids++", random_state: int | None = None, max_iter: int = 300):
        if metric not in METRICS or method not in ("alternate", "pam") or init not in ("k-medoids++", "random", "heuristic", "build"):
            raise ValueError(f"unknown metric, method or init: {metric!r}, {method!r}, {init!r}")
        self.k, self.metric, self.method, self.init, self.random_state, self.max_iter = k, metric, method, init, random_state, max_iter

    def _near(self, table: DataFrame, old: list[int], new: list[int]) -> DataFrame:
        """slice_id, x, ds (distances to new), medoid (the nearest), d1 and d2 (of the nearest two); stored.

        table has slice_id and x, and ds for the medoids in old; what stays of these is copied.
        """
        metric, added = self.metric, [m for m in new if m not in old]
        rows = {r["slice_id"]: r["x"] for r in table.where(F.col("slice_id").isin(added)).select("slice_id", "x").collect()}  # at most k
        wanted, places, names = np.array([rows[m] for m in added], float), [old.index(m) if m in old else len(old) + added.index(m) for m in new], np.array(new, np.int32)

        def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.num_rows
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(float)
                fresh = distance_matrix(x, wanted, metric) if len(added) else np.zeros((n, 0))
                kept = batch.column("ds").flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if old else fresh[:, :0]
                ds = np.concatenate([kept, fresh], axis=1)[:, places]
                nearest = ds.argmin(axis=1)
                first = ds[np.arange(n), nearest]
                second = np.partition(ds, 1, axis=1)[:, 1] if len(new) > 1 else np.full(n, np.inf)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(new)), pa.array(ds.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("slice_id"), batch.column("x"), lists, pa.array(names[nearest]), pa.array(first), pa.array(second)], ["slice_id", "x", "ds", "medoid", "d1", "d2"])

        columns = ["slice_id", "x"] + (["ds"] if old else [])
        return stored(table.select(*columns).mapInArrow(measured, "slice_id int, x array<double>, ds array<double>, medoid int, d1 double, d2 double"), "near")

    def _drawn(self, step: int):
        """A number between 0 and 1 for each slice, by seed and step."""
        return (F.pmod(F.xxhash64("slice_id", F.lit(self.random_state or 0), F.lit(step)), F.lit(1 << 52)) + 0.5) / float(1 << 52)

    def _start(self, context: ProblemContext, x: DataFrame) -> tuple[list[int], DataFrame]:
        """Starting medoids in order, and the table of distances to them."""
        if self.init == "random":
            medoids = sorted(r["slice_id"] for r in context.slices.orderBy(self._drawn(0), "slice_id").limit(self.k).collect())
            return medoids, self._near(x, [], medoids)
        by_seed = self.init == "k-medoids++" and self.random_state is not None
        if by_seed:
            medoids = [context.slices.agg(F.min_by("slice_id", self._drawn(0))).first()[0]]
        else:
            central = sums_by_slice(x, self.metric).orderBy("s", "slice_id").limit(self.k if self.init == "heuristic" else 1)
            medoids = sorted(r["slice_id"] for r in central.collect())
        near = self._near(x, [], medoids)
        while len(medoids) < self.k:
            if self.init == "build":
                found = reduced(near.select("slice_id", "x", "d1"), self.metric, _covered, "slice_id int, s double")
                found = found.where(~F.col("slice_id").isin(medoids)).groupBy("slice_id").agg(F.sum("s").alias("s")).agg(F.min_by("slice_id", F.struct("s", "slice_id")))
            else:
                far = near.where(~F.col("slice_id").isin(medoids))
                if by_seed:
                    # the smallest of exponential waiting times with rates of squared distances
                    wait = F.try_divide(-F.log(self._drawn(len(medoids))), F.col("d1") * F.col("d1"))
                    found = far.agg(F.min_by("slice_id", F.struct(wait.isNull(), wait, "slice_id")))
                else:
                    found = far.agg(F.max_by("slice_id", F.struct("d1", -F.col("slice_id"))))
            grown = [*medoids, found.first()[0]]
            near, medoids = self._near(near, medoids, grown), grown
        ordered = sorted(medoids)
        return ordered, near if ordered == medoids else self._near(near, medoids, ordered)

    def _updated(self, near: DataFrame, medoids: list[int]) -> list[int]:
        """Of each cluster the member with the smallest sum of distances to the others."""
        costs = sums_by_slice(near.select("slice_id", "x", "medoid"), self.metric, within="medoid").join(near.select("slice_id", "medoid"), "slice_id")
        return sorted(r["m"] for r in costs.groupBy("medoid").agg(F.min_by("slice_id", F.struct("s", "slice_id")).alias("m")).collect())

    def _swapped(self, near: DataFrame, medoids: list[int]) -> list[int]:
        """Medoids after the best swap; the same where none helps."""
        parts = reduced(near.select("slice_id", "x", "medoid", "d1", "d2"), self.metric, _swap_parts, "j int, medoid int, gain double, more double")
        sums = parts.where(~F.col("j").isin(medoids)).groupBy("j", "medoid").agg(F.sum("gain").alias("gain"), F.sum("more").alias("more"))
        total = sums.groupBy("j").agg(F.sum("gain").alias("all"))
        best = sums.join(total, "j").select("j", "medoid", (F.col("all") + F.col("more")).alias("change")).agg(F.min(F.struct("change", "medoid", "j")).alias("best")).first()[0]
        if best is None or best["change"] >= -1e-12:
            return medoids
        return sorted([m for m in medoids if m != best["medoid"]] + [best["j"]])

    def find_selection(self, context):
        if not 1 <= self.k <= context.slices.count():
            raise ValueError("k must lie between 1 and the number of slices")
        medoids, near = self._start(context, stored(context.feature_vectors(), "vectors"))
        steps = 0
        for steps in range(1, self.max_iter + 1):
            new = self._updated(near, medoids) if self.method == "alternate" else self._swapped(near, medoids)
            if new == medoids:
                break
            near, medoids = self._near(near, medoids, new), new
        clusters = stored(cluster_table(context, near.select("slice_id", F.col("medoid").alias("cluster"))), "clusters")
        rows = {r["cluster"]: r for r in clusters.collect()}
        n, wcss = sum(r["size"] for r in rows.values()), sum(r["wcss"] for r in rows.values())
        inertia = near.agg(F.sum("d1")).first()[0]
        selection = _labels(context, medoids)
        weights = _weights(context, [(m, rows[m]["size"] / n if m in rows else 0.0) for m in medoids])
        return RepSetResult(context, "subset", selection, {"wcss": wcss}, representatives_of(context, selection), weights, {"inertia": inertia, "n_iter": steps, "cluster_info": clusters})


def _covered(d: np.ndarray, own: dict, other: dict) -> dict:
    """For each slice of the other block what the own slices would be away from the nearest medoid if it were one."""
    return {"slice_id": other["slice_id"].astype(np.int32), "s": np.minimum(d, own["d1"][:, None]).sum(axis=0)}


def _swap_parts(d: np.ndarray, own: dict, other: dict) -> dict:
    """What the own slices gain by each slice j of the other block as a further medoid, by their medoid, and what they lose if that goes."""
    gain = np.minimum(d - own["d1"][:, None], 0.0)
    more = np.minimum(d, own["d2"][:, None]) - own["d1"][:, None] - gain
    names, of = np.unique(own["medoid"], return_inverse=True)
    sums = [np.stack([part[of == m].sum(axis=0) for m in range(len(names))]) for part in (gain, more)]
    j = other["slice_id"].astype(np.int32)
    return {"j": np.tile(j, len(names)), "medoid": np.repeat(names.astype(np.int32), len(j)), "gain": sums[0].ravel(), "more": sums[1].ravel()}


def cluster_table(context: ProblemContext, assigned: DataFrame) -> DataFrame:
    """cluster, size, first and last slice, wcss (around the centroid) and nearest, the member nearest to it."""
    x = context.feature_vectors().join(assigned, "slice_id").select("cluster", "slice_id", F.posexplode("x").alias("f", "v"))
    centre = x.groupBy("cluster", "f").agg(F.avg("v").alias("m"))
    off = x.join(centre, ["cluster", "f"]).groupBy("cluster", "slice_id").agg(F.sum((F.col("v") - F.col("m")) ** 2).alias("q"))
    return off.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.min("slice_id").alias("first"), F.max("slice_id").alias("last"), F.sum("q").alias("wcss"), F.min_by("slice_id", F.struct("q", "slice_id")).alias("nearest"))


class CTPCSearch(SearchAlgorithm):
    """Chronological clusters: runs of consecutive slices, merged with a neighbour while there are more than k.

    linkage 'ward' merges the neighbours whose variance grows least, 'complete' and 'average'
    those with the smallest largest or mean distance between members. 'single' comes to cutting
    the k - 1 widest gaps between consecutive slices, which needs no merging. (Structured
    clustering on a chain that never combines distances gives the gap cut for 'complete' and
    'average' too; here they have their textbook meaning.) Merging is one step after the other,
    on the feature vectors of all slices, which reach the driver: one row per calendar period.
    Segments are numbered in time order; the representative is the member nearest to the centroid.
    """

    gives_weights = True

    def __init__(self, k: int, linkage: str = "ward"):
        if linkage not in ("ward", "single", "complete", "average"):
            raise ValueError(f"unknown linkage {linkage!r}")
        self.k, self.linkage = k, linkage

    def segments(self, context: ProblemContext) -> DataFrame:
        """slice_id and cluster, numbered from 0 in time order."""
        if self.k < 1 or self.k > context.slices.count():
            raise ValueError("k must lie between 1 and the number of slices")
        if self.linkage == "single":
            return gap_segments(context, self.k)
        rows = context.feature_vectors().orderBy("slice_id").collect()
        starts = merged_runs(np.array([r["x"] for r in rows], float), self.k, self.linkage)
        bounds = [(c, int(rows[a]["slice_id"]), int(rows[b - 1]["slice_id"])) for c, (a, b) in enumerate(zip(starts, [*starts[1:], len(rows)], strict=True))]
        table = context.slices.sparkSession.createDataFrame(bounds, "cluster int, a int, b int")
        return context.slices.select("slice_id").join(F.broadcast(table), F.col("slice_id").between(F.col("a"), F.col("b"))).select("slice_id", "cluster")

    def find_selection(self, context):
        clusters = cluster_table(context, self.segments(context)).persist()
        rows = clusters.orderBy("cluster").collect()
        n = sum(r["size"] for r in rows)
        reps = [r["nearest"] for r in rows]
        selection = _labels(context, reps)
        wcss = sum(r["wcss"] for r in rows)
        weights = _weights(context, [(r["nearest"], r["size"] / n) for r in rows])
        return RepSetResult(context, "chronological", selection, {"wcss": wcss}, representatives_of(context, selection), weights, {"segments": clusters})


def merged_runs(x: np.ndarray, k: int, linkage: str) -> list[int]:
    """First places of the k runs that merging neighbours leaves; of equal costs the earliest pair merges."""
    n = len(x)
    sums = np.vstack([np.zeros(x.shape[1]), np.cumsum(x, axis=0)])
    end = {a: a + 1 for a in range(n)}  # of the run that starts at a
    begin = {a + 1: a for a in range(n)}  # of the run that ends there

    def cost(a: int, b: int, c: int) -> float:
        if linkage == "ward":
            gap = (sums[b] - sums[a]) / (b - a) - (sums[c] - sums[b]) / (c - b)
            return (b - a) * (c - b) / (c - a) * float(gap @ gap)
        far, total = 0.0, 0.0  # block by block, so that two long runs need no table of all their pairs
        for i in range(a, b, BLOCK):
            for j in range(b, c, BLOCK):
                d = distance_matrix(x[i : min(i + BLOCK, b)], x[j : min(j + BLOCK, c)], "euclidean")
                far, total = max(far, float(d.max())), total + float(d.sum())
        return far if linkage == "complete" else total / ((b - a) * (c - b))

    heap = [(cost(a, a + 1, a + 2), a, a + 1, a + 2) for a in range(n - 1)]
    heapq.heapify(heap)
    while len(end) > k:
        _, a, b, c = heapq.heappop(heap)
        if end.get(a) != b or end.get(b) != c:  # one of the two has merged since
            continue
        del end[b], begin[b]
        end[a], begin[c] = c, a
        if c in end:
            heapq.heappush(heap, (cost(a, c, end[c]), a, c, end[c]))
        if a in begin:
            heapq.heappush(heap, (cost(begin[a], a, c), begin[a], a, c))
    return sorted(end)


def gap_segments(context: ProblemContext, k: int) -> DataFrame:
    """Runs of slices cut at the k - 1 largest distances between consecutive slices."""
    x = context.feature_vectors()
    before = x.select((F.col("slice_id") + 1).alias("slice_id"), F.col("x").alias("_before"))
    # from here on a slice is a number and a gap: one short row per calendar period
    gaps = x.join(before, "slice_id", "left").select("slice_id", METRICS["euclidean"]("x", "_before").alias("gap"))
    order = Window.orderBy("slice_id")
    rank = F.row_number().over(Window.orderBy(F.col("gap").desc_nulls_last(), "slice_id"))
    cuts = gaps.withColumn("cut", ((rank < k) & F.col("gap").isNotNull()).cast("int"))
    return cuts.select("slice_id", F.sum("cut").over(order).cast("int").alias("cluster"))


class HullClusteringSearch(SearchAlgorithm):
    """Slices on the hull: the farthest from the mean, then again and again the worst projected one."""

    def __init__(self, k: int, hull_type: str = "convex"):
        if hull_type not in ("convex", "conic"):
            raise ValueError(f"unknown hull type {hull_type!r}")
        self.k, self.hull_type = k, hull_type

    def errors(self, context: ProblemContext, vertices: list[list[float]]) -> DataFrame:
        """slice_id and e, the distance of each slice from the hull of vertices."""
        hull = np.array(vertices, float)
        weigh = nonnegative_weights if self.hull_type == "conic" else simplex_weights

        def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = [float(np.linalg.norm(z - weigh(z, hull) @ hull)) for z in (np.asarray(v, float) for v in frame["x"])]
                yield pd.DataFrame({"slice_id": frame["slice_id"], "e": out})

        return context.feature_vectors().mapInPandas(project, "slice_id int, e double")

    def find_selection(self, context):
        x = context.feature_vectors().persist()
        if not 1 <= self.k <= x.count():
            raise ValueError("k must lie between 1 and the number of slices")
        long = x.select("slice_id", F.posexplode("x").alias("f", "v"))
        mean = long.groupBy("f").agg(F.avg("v").alias("m"))
        far = long.join(F.broadcast(mean), "f").groupBy("slice_id").agg(F.sum((F.col("v") - F.col("m")) ** 2).alias("d"))
        chosen = [far.agg(F.max_by("slice_id", F.struct("d", -F.col("slice_id")))).first()[0]]
        vertices = [x.where(F.col("slice_id") == chosen[0]).first()["x"]]
        while len(chosen) < self.k:
            rest = self.errors(context, vertices).where(~F.col("slice_id").isin(chosen))
            chosen.append(rest.agg(F.max_by("slice_id", F.struct("e", -F.col("slice_id")))).first()[0])
            vertices.append(x.where(F.col("slice_id") == chosen[-1]).first()["x"])
        left = self.errors(context, vertices).where(~F.col("slice_id").isin(chosen)).agg(F.sum("e")).first()[0] or 0.0
        selection = _labels(context, chosen)
        return RepSetResult(context, "subset", selection, {"projection_error": left}, representatives_of(context, selection))


class SnippetSearch(SearchAlgorithm):
    """Multi-day windows that greedily cover all days; a day's distance to a window is that to its nearest day.

    first_pick 'first' takes the first window of the horizon, as the greedy rule from infinite
    distances does; 'best' takes the window of least total distance.
    """

    gives_weights = True

    def __init__(self, k: int, period_length_days: int = 7, step_days: int = 1, first_pick: str = "first"):
        self.k, self.length, self.step, self.first_pick = k, period_length_days, step_days, first_pick

    def window_distances(self, context: ProblemContext) -> DataFrame:
        """i (day), w (window, named by its first day) and d, the least squared distance to a day of the window."""
        n = context.slices.count()
        last = n - self.length
        if last < 0 or last // self.step + 1 < self.k:
            raise ValueError("there are too few windows")
        # a window that slides over each day's distances in time; every step_days-th one is kept
        ahead = Window.partitionBy("i").orderBy("j").rowsBetween(0, self.length - 1)
        least = context.distances.select("i", F.col("j").alias("w"), F.min(F.col("d") * F.col("d")).over(ahead).alias("d"))
        return least.where((F.col("w") <= last) & (F.col("w") % self.step == 0))

    def find_selection(self, context):
        if context.slicer.unit != "day":
            raise ValueError("snippets need slices of a day")
        d = stored(self.window_distances(context), "windows")
        if self.first_pick == "first":
            chosen = [0]
        else:
            chosen = [d.groupBy("w").agg(F.sum("d").alias("s")).agg(F.min_by("w", F.struct("s", "w"))).first()[0]]
        while len(chosen) < self.k:
            now = d.where(F.col("w").isin(chosen)).groupBy("i").agg(F.min("d").alias("now"))
            left = d.where(~F.col("w").isin(chosen)).join(now, "i").groupBy("w").agg(F.sum(F.least("d", "now")).alias("s"))
            chosen.append(left.agg(F.min_by("w", F.struct("s", "w"))).first()[0])
        order = F.element_at(F.create_map(*[F.lit(v) for i, w in enumerate(chosen) for v in (w, i)]), F.col("w"))
        near = d.where(F.col("w").isin(chosen)).withColumn("pos", order).groupBy("i").agg(F.min_by("w", F.struct("d", "pos")).alias("w"), F.min("d").alias("d")).transform(stored, "nearest")
        rows = {r["w"]: r for r in near.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("s")).collect()}
        n = sum(r["n"] for r in rows.values())
        selection = _labels(context, chosen)
        windows = context.slices.sparkSession.createDataFrame([(w, w + i) for w in chosen for i in range(self.length)], "snippet int, slice_id int")
        weights = _weights(context, [(w, rows[w]["n"] / n if w in rows else 0.0) for w in chosen])
        total = sum(r["s"] for r in rows.values())
        return RepSetResult(context, "subset", selection, {"total_distance": total}, context.rows.join(F.broadcast(windows), "slice_id"), weights, {"assignment": near})


class OptimizationSearch(SearchAlgorithm):
    def find_selection(self, context):
        raise NotImplementedError("selection by mathematical programming")
