"""Score components: every candidate scored in one distributed job.

A component reduces the series to summaries per slice in one scan (value counts, moments,
hour sums, distances), joins them with the members of all candidates and aggregates by
candidate. ``score_all`` gives combo_id and score; ``score`` is its value for one selection.
"""

from __future__ import annotations

from abc import ABC, abstractmethod

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tidemark.functions.blocks import distance_matrix, reduced, sums_by_slice
from tidemark.functions.kernels import dtw_abs, dtw_multivariate
from tidemark.functions.order import quantiles
from tidemark.operators.combos import members_of
from tidemark.operators.features import DirectProfileFeatureEngineer
from tidemark.plans.context import ProblemContext
from tidemark.sources.tables import stored

TINY = 1e-12


def normalised_weights(weights: dict[str, float] | None, keys: list[str]) -> dict[str, float]:
    """No weights: 1 for each key; some: 0 for the keys left out."""
    return dict.fromkeys(keys, 1.0) if weights is None else {k: float(weights.get(k, 0.0)) for k in keys}


class ScoreComponent(ABC):
    """A measure of how well candidates stand in for the whole series."""

    name: str
    direction: str = "min"
    empty: float = float("nan")  # of a selection without slices, or without values

    def prepare(self, context: ProblemContext) -> None:
        self.context = context

    @abstractmethod
    def score_all(self, members: DataFrame) -> DataFrame:
        """combo_id and score of each candidate in members (combo_id, pos, slice_id)."""

    def score(self, combination: tuple[str, ...]) -> float:
        """Score of one selection given by slice labels."""
        chosen = self.context.slices.where(F.col("slice_label").isin(list(combination)))
        one = chosen.agg(F.array_sort(F.collect_list("slice_id")).alias("slice_ids")).select(F.lit(0).cast("long").alias("combo_id"), "slice_ids")
        found = self.score_all(members_of(one)).first()
        return self.empty if found is None or found["score"] is None else found["score"]

    def _weight(self, weights: dict[str, float] | None) -> Column:
        known = normalised_weights(weights, self.context.variables)
        return F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), F.col("variable"))


class _Curves(ScoreComponent):
    """Shared by scores that compare whole distributions value by value.

    A variable's distinct values are cut into chunks of the context's size. Candidates meet a chunk of the
    whole in groups of GROUP, as one block of arrays, so neither a row nor a task holds a whole
    distribution.
    """

    GROUP = 512

    def __init__(self, variable_weights: dict[str, float] | None = None):
        self.variable_weights = variable_weights

    def prepare(self, context):
        super().prepare(context)
        self.grid, self.spread = context.grid, context.spread

    def _compared(self, members: DataFrame, own: DataFrame, full: DataFrame, function, schema: str) -> DataFrame:
        """function(own rows, rows of the whole) for each variable, chunk and group of candidates."""
        most = members.agg(F.max("combo_id")).first()[0] or 0
        own = own.withColumn("part", F.expr(f"combo_id div {self.GROUP}"))
        full = full.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(most // self.GROUP).cast("long"))))
        full = full.select(*[F.col(c).alias(c) for c in full.columns])  # columns of its own, whatever both sides come from
        keys = ["variable", "chunk", "part"]
        return own.groupBy(*keys).cogroup(full.groupBy(*keys)).applyInArrow(function, schema)


class WassersteinFidelity(_Curves):
    """Weighted sum over variables of the first Wasserstein distance to the whole, in quartile ranges.

    The distance is the sum over the whole's distinct values of the difference of the two
    distribution functions times the gap to the next value. A slice holds, per chunk of
    values, its counts there and how many rows it has below.
    """

    name = "wasserstein"

    def prepare(self, context):
        super().prepare(context)
        chunk = F.expr(f"at div {context.chunk}").alias("chunk")
        following = self.grid.select("variable", (F.col("at") - 1).alias("at"), F.col("value").alias("next"))
        steps = self.grid.join(following, ["variable", "at"], "left").select("variable", chunk, F.struct("at", ((F.col("before") + F.col("n")) / F.col("total")).alias("cdf"), F.coalesce(F.col("next") - F.col("value"), F.lit(0.0)).alias("gap")).alias("step"))
        self.full = steps.groupBy("variable", "chunk").agg(F.array_sort(F.collect_list("step")).alias("steps")).transform(stored, "steps")
        self.held = context.held

    def score_all(self, members):
        def distances(own: pa.Table, full: pa.Table) -> pa.Table:
            steps = full.column("steps").combine_chunks().flatten()
            at, cdf, gap = (steps.field(k).to_numpy(zero_copy_only=False) for k in ("at", "cdf", "gap"))
            ids, row = np.unique(own.column("combo_id").to_numpy(), return_inverse=True)
            below, rows = np.zeros(len(ids)), np.zeros(len(ids))
            np.add.at(below, row, own.column("below").to_numpy())
            np.add.at(rows, row, own.column("rows").to_numpy())
            counts = np.zeros((len(ids), len(at)))
            held = own.column("held").combine_chunks()
            lengths = held.value_lengths().fill_null(0).to_numpy()
            entries = held.flatten()
            if len(at) and len(entries):
                np.add.at(counts, (np.repeat(row, lengths), entries.field("at").to_numpy() - at[0]), entries.field("n").to_numpy())
            cdf_own = (below[:, None] + np.cumsum(counts, axis=1)) / rows[:, None]
            variable = own.column("variable")[0].as_py() if len(ids) else ""
            return pa.table({"combo_id": ids, "variable": pa.array([variable] * len(ids), pa.string()), "d": np.abs(cdf_own - cdf[None, :]) @ gap})

        own = members.select("combo_id", "slice_id").join(self.held.drop("here"), "slice_id").drop("slice_id")
        found = self._compared(members, own, self.full, distances, "combo_id long, variable string, d double").join(F.broadcast(self.spread), "variable")  # one row per variable
        return found.groupBy("combo_id").agg(F.sum(self._weight(self.variable_weights) * F.col("d") / F.col("spread")).alias("score"))


class DurationCurveFidelity(_Curves):
    """Weighted sum of root mean square differences of quantiles, in quartile ranges.

    A candidate's quantiles are order statistics of its slices' values together. Chunk by chunk of
    the whole's values the slices' counts add up, so a chunk knows which of the wanted ranks lie in
    it; a rank that falls there is looked up and gives its part of the interpolation.
    """

    name, empty = "nrmse_duration_curve", float("inf")

    def __init__(self, n_quantiles: int = 101, variable_weights: dict[str, float] | None = None):
        super().__init__(variable_weights)
        self.points = [float(p) for p in np.linspace(0, 1, n_quantiles)]

    def prepare(self, context):
        super().prepare(context)
        whole = quantiles(self.grid, self.points).select("variable", F.posexplode("q").alias("point", "whole"))
        self.whole = whole.transform(stored, "quantiles")
        values = self.grid.groupBy("variable", F.expr(f"at div {context.chunk}").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("steps"))
        self.full = values.select("variable", "chunk", F.transform("steps", lambda s: s["value"]).alias("values")).transform(stored, "curve")
        self.held = context.held

    def score_all(self, members):
        points, size = np.array(self.points), self.context.chunk

        def parts(own: pa.Table, full: pa.Table) -> pa.Table:
            value = full.column("values").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            ids, row = np.unique(own.column("combo_id").to_numpy(), return_inverse=True)
            sums = np.zeros((2, len(ids)), np.int64)
            for k, name in enumerate(("below", "rows")):
                np.add.at(sums[k], row, own.column(name).to_numpy())
            counts = np.zeros((len(ids), len(value)), np.int64)
            held = own.column("held").combine_chunks()
            entries = held.flatten()
            if len(value) and len(entries):
                at = entries.field("at").to_numpy() - own.column("chunk")[0].as_py() * size
                np.add.at(counts, (np.repeat(row, held.value_lengths().fill_null(0).to_numpy()), at), entries.field("n").to_numpy())
            ends = np.cumsum(counts, axis=1)
            out = []
            for i in range(len(ids)):
                rank = points * (sums[1, i] - 1)
                low = np.floor(rank)
                share = np.stack([low + 1 - rank, rank - low])  # of the rank below and the one above
                places = np.stack([low, low + 1]).astype(np.int64) - sums[0, i]
                k, p = np.nonzero((places >= 0) & (places < (ends[i, -1] if len(value) else 0)) & (share > 0))
                found = value[np.searchsorted(ends[i], places[k, p], side="right")] * share[k, p]
                out.append((np.full(len(p), ids[i]), p, found))
            ids, p, found = (np.concatenate([o[j] for o in out]) if out else np.zeros(0) for j in range(3))
            variable = own.column("variable")[0].as_py() if own.num_rows else ""
            return pa.table({"combo_id": pa.array(ids.astype(np.int64)), "variable": pa.array([variable] * len(ids), pa.string()), "point": pa.array(p.astype(np.int32)), "part": pa.array(found.astype(float))})

        # a chunk needs what all slices have below it, those without values in it too
        own = members.select("combo_id", "slice_id").join(self.held.drop("here"), "slice_id").drop("slice_id")
        found = self._compared(members, own, self.full, parts, "combo_id long, variable string, point int, part double")
        off = found.groupBy("combo_id", "variable", "point").agg(F.sum("part").alias("own")).join(F.broadcast(self.whole), ["variable", "point"])  # points of each variable
        rmse = off.groupBy("combo_id", "variable").agg(F.sqrt(F.sum((F.col("own") - F.col("whole")) ** 2) / len(self.points)).alias("rmse")).join(F.broadcast(self.spread), "variable")
        return rmse.groupBy("combo_id").agg(F.sum(self._weight(self.variable_weights) * F.col("rmse") / F.col("spread")).alias("score"))


class NRMSEFidelity(_Curves):
    """Weighted sum of root mean square differences of full duration curves, in means.

    A candidate's sorted values are resampled to the ranks of the whole, which is its quantile
    function at i / (n - 1). A variable of negative mean gives a negative term. Ranks of the
    whole are compared in chunks, each with the part of the candidate's curve that it needs.
    """

    name, empty = "nrmse", float("inf")

    def prepare(self, context):
        super().prepare(context)
        last = F.col("before") + F.col("n") - 1
        chunks = F.explode(F.sequence(F.expr(f"before div {context.chunk}"), F.expr(f"(before + n - 1) div {context.chunk}"))).alias("chunk")
        runs = self.grid.select("variable", "value", F.col("before").alias("first"), last.alias("last"), "total", chunks)
        self.full = runs.groupBy("variable", "chunk").agg(F.array_sort(F.collect_list(F.struct("first", "last", "value"))).alias("runs"), F.first("total").alias("total")).transform(stored, "runs")
        self.means = self.grid.groupBy("variable").agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"), F.first("total").alias("total")).transform(stored, "means")

    def score_all(self, members):
        size = self.context.chunk

        def squares(own: pa.Table, full: pa.Table) -> pa.Table:
            if not own.num_rows or not full.num_rows:
                return pa.table({"combo_id": pa.array([], pa.int64()), "variable": pa.array([], pa.string()), "q": pa.array([], pa.float64())})
            runs = full.column("runs").combine_chunks().flatten()
            a, b, value = (runs.field(k).to_numpy(zero_copy_only=False) for k in ("first", "last", "value"))
            chunk, n = own.column("chunk")[0].as_py(), full.column("total")[0].as_py()
            rank = np.arange(chunk * size, min((chunk + 1) * size, n))
            whole = value[np.searchsorted(b, rank)]
            ids, m = own.column("combo_id").to_numpy(), own.column("rows").to_numpy()
            own_a, own_b, own_value = (own.column(k).to_numpy() for k in ("first", "last", "value"))
            order = np.lexsort((own_a, ids))
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(ids[order])) + 1, [len(order)]])
            out = []
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                on = order[x:y]
                at = rank * ((m[on[0]] - 1) / max(n - 1, 1))
                knots = np.column_stack([own_a[on], own_b[on]]).ravel()
                out.append(float(((np.interp(at, knots, np.repeat(own_value[on], 2)) - whole) ** 2).sum()))
            found = ids[order[cuts[:-1]]]
            return pa.table({"combo_id": found, "variable": pa.array([own.column("variable")[0].as_py()] * len(found), pa.string()), "q": np.array(out)})

        counts = self.context.value_counts
        own = members.select("combo_id", "slice_id").join(counts, "slice_id").groupBy("combo_id", "variable", "value").agg(F.sum("n").alias("n"))
        whole, upward = Window.partitionBy("combo_id", "variable"), Window.partitionBy("combo_id", "variable").orderBy("value")
        own = own.withColumns({"last": F.sum("n").over(upward) - 1, "rows": F.sum("n").over(whole)}).withColumn("first", F.col("last") - F.col("n") + 1)
        own = own.join(F.broadcast(self.means), "variable")  # one row per variable
        # ranks of the whole that fall between the values before and after this one
        stretch = (F.col("total") - 1) / F.greatest(F.col("rows") - 1, F.lit(1))
        low = F.when(F.col("first") == 0, 0).otherwise(F.floor((F.col("first") - 1) * stretch))
        high = F.when(F.col("last") == F.col("rows") - 1, F.col("total") - 1).otherwise(F.least(F.ceil((F.col("last") + 1) * stretch), F.col("total") - 1))
        chunks = F.explode(F.sequence(F.floor(low / size).cast("long"), F.floor(high / size).cast("long"))).alias("chunk")
        own = own.select("combo_id", "variable", "value", "first", "last", "rows", chunks)
        found = self._compared(members, own, self.full, squares, "combo_id long, variable string, q double")
        found = found.groupBy("combo_id", "variable").agg(F.sum("q").alias("q")).join(F.broadcast(self.means), "variable")
        term = self._weight(self.variable_weights) * F.sqrt(F.col("q") / F.col("total")) / (F.col("mean") + TINY)
        return found.withColumn("t", term).groupBy("combo_id").agg(F.sum("t").alias("score"))


class CorrelationFidelity(ScoreComponent):
    """Frobenius distance of correlation matrices, relative to that of the whole.

    A variable that is constant in the whole or in a selection makes the score null.
    """

    name = "correlation"

    def prepare(self, context):
        super().prepare(context)
        names = context.variables
        self.pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
        means = context.rows.agg(*[F.avg(c).alias(f"_m_{c}") for c in names])
        centred = context.rows.crossJoin(F.broadcast(means)).select("slice_id", *[(F.col(c) - F.col(f"_m_{c}")).alias(c) for c in names])
        sums = []
        for a, b in self.pairs:
            both = F.col(a).isNotNull() & F.col(b).isNotNull()
            x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
            for key, value in (("n", F.when(both, 1.0)), ("x", x), ("y", y), ("xx", x * x), ("yy", y * y), ("xy", x * y)):
                sums.append(F.coalesce(F.sum(value), F.lit(0.0)).alias(f"{key}_{a}_{b}"))
        sums = sums or [F.count(F.lit(1)).alias("n")]
        self.moments = stored(centred.groupBy("slice_id").agg(*sums), "moments")
        self.columns = [c for c in self.moments.columns if c != "slice_id"]
        self.full = self._correlations(self.moments.agg(*[F.sum(c).alias(c) for c in self.columns])).first()

    def _correlations(self, sums: DataFrame) -> DataFrame:
        def r(a: str, b: str) -> Column:
            n, x, y, xx, yy, xy = (F.col(f"{k}_{a}_{b}") for k in ("n", "x", "y", "xx", "yy", "xy"))
            vx, vy = n * xx - x * x, n * yy - y * y
            small = (vx <= TINY * F.abs(n * xx)) | (vy <= TINY * F.abs(n * yy))
            return F.when(~small, (n * xy - x * y) / (F.sqrt(vx) * F.sqrt(vy))).alias(f"r_{a}_{b}")

        keep = [c for c in sums.columns if c not in self.columns]
        return sums.select(*keep, *[r(a, b) for a, b in self.pairs])

    def score_all(self, members):
        sums = members.join(self.moments, "slice_id").groupBy("combo_id").agg(*[F.sum(c).alias(c) for c in self.columns])
        own = self._correlations(sums)
        known = [self.full[f"r_{a}_{b}"] for a, b in self.pairs]
        if any(v is None for v in known):
            return own.select("combo_id", F.lit(None).cast("double").alias("score"))
        off = sum(((F.col(f"r_{a}_{b}") - v) * (F.col(f"r_{a}_{b}") - v) for (a, b), v in zip(self.pairs, known, strict=True)), F.lit(0.0))
        norm = float(np.sqrt(len(self.context.variables) + 2 * sum(v * v for v in known))) + TINY
        return own.select("combo_id", (F.sqrt(2 * off) / norm).alias("score"))


class _HourProfiles(ScoreComponent):
    """Shared by scores on mean values by hour of day."""

    def prepare(self, context):
        super().prepare(context)
        self.hours = context.observations.groupBy("slice_id", "variable", F.hour("ts").alias("hour")).agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n")).transform(stored, "hours")
        self.full = self.hours.groupBy("variable", "hour").agg((F.sum("s") / F.sum("n")).alias("a"))

    def _own(self, members: DataFrame) -> DataFrame:
        own = members.join(self.hours, "slice_id").groupBy("combo_id", "variable", "hour").agg((F.sum("s") / F.sum("n")).alias("b"))
        return own.join(F.broadcast(self.full), ["variable", "hour"])  # at most 24 rows per variable


class DiurnalFidelity(_HourProfiles):
    """Mean square difference of mean daily profiles, relative to the profile's mean square."""

    name = "diurnal"

    def score_all(self, members):
        per_variable = self._own(members).groupBy("combo_id", "variable").agg(F.avg((F.col("a") - F.col("b")) ** 2).alias("d"), F.avg(F.col("a") ** 2).alias("s"))
        return per_variable.groupBy("combo_id").agg((F.avg("d") / (F.avg("s") + TINY)).alias("score"))


class DiurnalDTWFidelity(_HourProfiles):
    """Sum over variables of warped distances of mean daily profiles, in deviations of the profile."""

    name, empty = "diurnal_dtw", float("inf")

    def __init__(self, variable_weights: dict[str, float] | None = None):
        self.variable_weights = variable_weights

    def score_all(self, members):
        @pandas_udf("double")
        def warped(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([dtw_abs(x, y) for x, y in zip(a, b, strict=True)])

        own = self._own(members).groupBy("combo_id", "variable").agg(F.array_sort(F.collect_list(F.struct("hour", "a", "b"))).alias("p"))
        deviation = self.full.groupBy("variable").agg(F.stddev_samp("a").alias("dev")).select("variable", F.when(F.coalesce("dev", F.lit(0.0)) == 0, 1.0).otherwise(F.col("dev")).alias("dev"))
        arrays = own.select("combo_id", "variable", F.transform("p", lambda s: s["a"]).alias("a"), F.transform("p", lambda s: s["b"]).alias("b")).join(F.broadcast(deviation), "variable")
        term = self._weight(self.variable_weights) * warped("a", "b") / F.col("dev")
        return arrays.withColumn("t", term).groupBy("combo_id").agg(F.sum("t").alias("score"))


class DTWFidelity(ScoreComponent):
    """Mean over the slices left out of the smallest warped distance to a selected slice.

    Distances of all pairs of slices are computed once, candidates are joined. Profiles meet in
    blocks of BLOCK, so a profile is sent once for each block and not for each pair.
    """

    name, BLOCK = "dtw", 8

    def prepare(self, context):
        super().prepare(context)
        width = len(context.variables)

        def warped(_, own: dict, other: dict) -> dict:
            rows = [(i, j, dtw_multivariate(x.reshape(-1, width), y.reshape(-1, width))) for i, x in zip(own["slice_id"], own["x"], strict=True) for j, y in zip(other["slice_id"], other["x"], strict=True) if i < j]
            return {n: np.array([r[k] for r in rows], kind) for k, (n, kind) in enumerate((("i", np.int32), ("j", np.int32), ("d", float)))}

        profiles = DirectProfileFeatureEngineer().profiles(context).select("slice_id", F.col("profile").alias("x"))
        half = reduced(profiles, None, warped, "i int, j int, d double", size=self.BLOCK).transform(stored, "pairs")
        self.pairs = half.unionByName(half.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))

    def score_all(self, members):
        near = members.select("combo_id", F.col("slice_id").alias("j")).join(self.pairs, "j")
        left_out = near.join(members.select("combo_id", F.col("slice_id").alias("i")), ["combo_id", "i"], "left_anti")
        means = left_out.groupBy("combo_id", "i").agg(F.min("d").alias("d")).groupBy("combo_id").agg(F.avg("d").alias("m"))
        return members.select("combo_id").distinct().join(means, "combo_id", "left").select("combo_id", F.coalesce("m", F.lit(0.0)).alias("score"))


class DiversityReward(ScoreComponent):
    """Mean distance of selected slices in feature space; 0 for fewer than two."""

    name, direction = "diversity", "max"

    SENT = 64 << 20  # bytes of feature vectors that are sent to all tasks

    def score_all(self, members):
        if self.context.slices.count() * len(self.context.feature_columns) * 8 <= self.SENT:
            means = self._by_candidate(members)
        else:
            a, b = members.alias("a"), members.alias("b")
            both = a.join(b, (F.col("a.combo_id") == F.col("b.combo_id")) & (F.col("a.pos") < F.col("b.pos")))
            both = both.select("a.combo_id", F.col("a.slice_id").alias("i"), F.col("b.slice_id").alias("j"))
            means = both.join(self.context.distances, ["i", "j"]).groupBy("combo_id").agg(F.avg("d").alias("m"))
        return members.select("combo_id").distinct().join(means, "combo_id", "left").select("combo_id", F.coalesce("m", F.lit(0.0)).alias("score"))

    def _by_candidate(self, members: DataFrame) -> DataFrame:
        """combo_id and m, distances being made for each candidate from the vectors of all slices."""
        rows = self.context.feature_vectors().orderBy("slice_id").collect()  # at most SENT bytes
        shared = members.sparkSession.sparkContext.broadcast((np.array([r["slice_id"] for r in rows]), np.array([r["x"] for r in rows], float)))

        def means(batches):
            ids, x = shared.value
            for batch in batches:
                out = []
                for chosen in batch.column("ids").to_pylist():
                    v = x[np.searchsorted(ids, chosen)]
                    d = distance_matrix(v, v, "euclidean")
                    out.append(float(d[np.triu_indices(len(v), 1)].mean()))
                yield pa.RecordBatch.from_arrays([batch.column("combo_id"), pa.array(out, pa.float64())], ["combo_id", "m"])

        lists = members.groupBy("combo_id").agg(F.sort_array(F.collect_list("slice_id")).alias("ids")).where(F.size("ids") > 1)
        return lists.mapInArrow(means, "combo_id long, m double")


class CentroidBalance(ScoreComponent):
    """Distance of the selection's mean feature vector from the origin, the centre of scaled features."""

    name = "centroid_balance"

    def score_all(self, members):
        x = self.context.feature_vectors().select("slice_id", F.posexplode("x").alias("f", "v"))
        means = members.join(x, "slice_id").groupBy("combo_id", "f").agg(F.avg("v").alias("m"))
        return means.groupBy("combo_id").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("score"))


class CoverageBalance(ScoreComponent):
    """How far the selected slices' shares of Gaussian kernel mass are from equal."""

    name = "coverage_balance"

    def __init__(self, gamma: float = 1.0):
        self.gamma = gamma

    def prepare(self, context):
        super().prepare(context)
        gamma = self.gamma
        mass = sums_by_slice(context.feature_vectors(), "euclidean", lambda d: np.exp(-gamma * d * d))
        self.mass = stored(mass.withColumnRenamed("s", "mass"), "mass")

    def score_all(self, members):
        per = Window.partitionBy("combo_id")
        held = members.join(self.mass, "slice_id").withColumns({"total": F.sum("mass").over(per), "k": F.count(F.lit(1)).over(per)})
        off = F.when(F.col("total") > 0, F.col("mass") / F.col("total") - 1 / F.col("k")).otherwise(0.0)
        return held.groupBy("combo_id").agg(F.sqrt(F.sum(off * off)).alias("score"))
