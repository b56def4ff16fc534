"""Feature engineers: one row of features per slice."""

from __future__ import annotations

from abc import ABC, abstractmethod

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.blocks import reduced
from tidemark.functions.order import quantiles, value_grid
from tidemark.plans.context import ProblemContext
from tidemark.sources.tables import stored

STATS = ("mean", "std", "q10", "q50", "q90", "iqr", "neg_share", "ramp_std")
SATURATED = 3.8  # what stands for the Fisher transform of a correlation next to 1


class FeatureEngineer(ABC):
    """Computes features; run gives a new context that holds them."""

    def run(self, context: ProblemContext) -> ProblemContext:
        return context.with_features(stored(self.calc_and_get_features_df(context), "features"))

    @abstractmethod
    def calc_and_get_features_df(self, context: ProblemContext) -> DataFrame:
        """slice_id and feature columns."""


class FeaturePipeline(FeatureEngineer):
    """Named engineers in order; each sees the features of those before it, and all are kept."""

    def __init__(self, engineers: dict[str, FeatureEngineer]):
        self.engineers = engineers

    def calc_and_get_features_df(self, context: ProblemContext) -> DataFrame:
        features: DataFrame | None = None
        for engineer in self.engineers.values():
            own = stored(engineer.calc_and_get_features_df(context), "features")
            features = own if features is None else features.join(own, "slice_id")
            context = context.with_features(features)
        if features is None:
            raise ValueError("a pipeline needs an engineer")
        return features


def slice_stats(context: ProblemContext) -> DataFrame:
    """The statistics of each slice before scaling: {stat}__{variable} and corr__{a}__{b}.

    One aggregation by slice over one scan, and quantiles by rank over the sorted values of all
    slices. iqr is the range from the 10 % to the 90 % quantile, ramp_std the deviation of
    differences of consecutive rows within the slice.
    """
    names = context.variables
    in_time = Window.partitionBy("slice_id").orderBy("ts")
    rows = context.rows.withColumns({f"_ramp_{c}": F.col(c) - F.lag(c).over(in_time) for c in names})
    aggregates = [F.count(F.lit(1)).alias("_rows")]
    for c in names:
        aggregates += [
            F.avg(c).alias(f"mean__{c}"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"std__{c}"),
            F.coalesce(F.try_divide(F.count_if(F.col(c) < 0), F.count(c)), F.lit(0.0)).alias(f"neg_share__{c}"),
            F.when(F.count(f"_ramp_{c}") == 0, 0.0).otherwise(F.stddev_samp(f"_ramp_{c}")).alias(f"ramp_std__{c}"),
        ]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    for a, b in pairs:
        aggregates += _moments(a, b)
    values = context.value_counts.select(F.struct("slice_id", "variable").alias("of"), "value", "n")
    q = quantiles(value_grid(values, "of", few=False), [0.1, 0.5, 0.9], "of").select("of.*", "q")
    q = q.groupBy("slice_id").agg(*[F.first(F.when(F.col("variable") == c, F.col("q")), ignorenulls=True).alias(f"_q_{c}") for c in names])
    found = rows.groupBy("slice_id").agg(*aggregates).join(q, "slice_id", "left")
    columns = {}
    for c in names:
        q = F.col(f"_q_{c}")
        columns |= {f"q10__{c}": q[0], f"q50__{c}": q[1], f"q90__{c}": q[2], f"iqr__{c}": q[2] - q[0]}
    columns |= {f"_r_{a}_{b}": correlation_of(a, b) for a, b in pairs}
    found = found.withColumns(columns)
    order = [F.col(f"{s}__{c}") for s in STATS for c in names]
    return found.select("slice_id", *order, *[F.col(f"_r_{a}_{b}").alias(f"_corr__{a}__{b}") for a, b in pairs], "_rows")


def _moments(a: str, b: str, n: str | None = None) -> list:
    """Sums over rows where both variables are known."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    return [F.covar_pop(a, b).alias(f"_xy_{a}_{b}"), F.var_pop(x).alias(f"_xx_{a}_{b}"), F.var_pop(y).alias(f"_yy_{a}_{b}"), F.count(x).alias(f"_n_{a}_{b}")]


def correlation_of(a: str, b: str):
    """Correlation from moments; null for fewer than two rows or a constant variable."""
    spread = F.sqrt(F.col(f"_xx_{a}_{b}")) * F.sqrt(F.col(f"_yy_{a}_{b}"))
    return F.when(F.col(f"_n_{a}_{b}") >= 2, F.try_divide(F.col(f"_xy_{a}_{b}"), spread))


def fisher(v):
    """Fisher's z of a correlation, saturated next to 1 and -1."""
    return F.when(F.abs(v) < 0.999, F.atanh(v)).otherwise(F.signum(v) * SATURATED)


class StandardStatsFeatureEngineer(FeatureEngineer):
    """Statistics per variable and Fisher-transformed correlations, as z-scores over slices.

    scale 'zscore' or 'none'. Slices of fewer than min_rows_for_corr rows have correlation 0.
    A statistic that is constant or that only one slice has scales to 0, and so do nulls.
    """

    def __init__(self, include_correlations: bool = True, min_rows_for_corr: int = 8, scale: str = "zscore"):
        self.include_correlations, self.min_rows, self.scale = include_correlations, min_rows_for_corr, scale
        self._names: list[str] = []

    def feature_names(self) -> list[str]:
        return list(self._names)

    def calc_and_get_features_df(self, context: ProblemContext) -> DataFrame:
        if self.scale not in ("zscore", "none"):
            raise NotImplementedError(f"scale {self.scale!r}")
        raw = slice_stats(context)
        few = F.col("_rows") < self.min_rows
        correlations = [c for c in raw.columns if c.startswith("_corr__")] if self.include_correlations else []
        plain = [c for c in raw.columns if "__" in c and not c.startswith("_")]
        raw = raw.select("slice_id", *plain, *[F.when(few, 0.0).otherwise(fisher(F.col(c))).alias(c[1:]) for c in correlations])
        self._names = raw.columns[1:]
        raw = stored(raw, "statistics")  # one row per slice, read for the scale and again to be scaled
        if self.scale == "none":
            return raw.select("slice_id", *[_finite(F.col(c)).alias(c) for c in self._names])
        whole = raw.groupBy().agg(*[F.avg(c).alias(f"_m_{c}") for c in self._names], *[F.stddev_samp(c).alias(f"_s_{c}") for c in self._names])
        scaled = []
        for c in self._names:
            deviation = F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}"))
            scaled.append(_finite((F.col(c) - F.col(f"_m_{c}")) / deviation).alias(c))
        return raw.crossJoin(F.broadcast(whole)).select("slice_id", *scaled)  # whole is one row


def _finite(column):
    return F.when(column.isNull() | F.isnan(column) | (F.abs(column) == float("inf")), 0.0).otherwise(column)


class DirectProfileFeatureEngineer(FeatureEngineer):
    """The values of a slice in time order, variable by variable within each row, as t0, t1, ...

    Shorter slices are padded with nulls at their end. A profile lies in one row, so it suits
    slices of bounded length.
    """

    def __init__(self, variable_weights: dict[str, float] | None = None):
        self.weights = variable_weights or {}

    def profiles(self, context: ProblemContext) -> DataFrame:
        """slice_id and profile, an array of its own length."""
        values = F.array(*[F.col(c) * float(self.weights.get(c, 1.0)) for c in context.variables])
        ordered = F.array_sort(F.collect_list(F.struct("ts", values.alias("v"))))
        return context.rows.groupBy("slice_id").agg(F.flatten(F.transform(ordered, lambda r: r["v"])).alias("profile"))

    def calc_and_get_features_df(self, context: ProblemContext) -> DataFrame:
        profiles = self.profiles(context).persist()
        width = profiles.agg(F.max(F.size("profile"))).first()[0] or 0
        return profiles.select("slice_id", *[F.get("profile", F.lit(i)).alias(f"t{i}") for i in range(width)])


class PCAFeatureEngineer(FeatureEngineer):
    """Principal components of the features that a context has, as pc_0, pc_1, ...

    n_components None: all; a whole number: so many; a fraction: the fewest that explain that
    share of variance. They are found on the smaller of two tables: the features' covariance,
    or, where features outnumber slices, the products of slices, made block by block; slices
    are projected where they are. Of each component the loading of largest size is positive;
    of n slices at most n - 1 components vary, and one without variance that the products do
    not determine has loadings of zero.
    """

    def __init__(self, n_components: int | float | None = None, whiten: bool = False):
        self.n_components, self.whiten = n_components, whiten
        self.components_ = self.explained_variance_ = self.explained_variance_ratio_ = None

    def calc_and_get_features_df(self, context: ProblemContext) -> DataFrame:
        if context.df_features is None:
            raise ValueError("PCA needs features; put an engineer before it in a pipeline")
        names = context.feature_columns
        x = context.features.select("slice_id", F.array(*[_finite(F.col(f"`{c}`").cast("double")) for c in names]).alias("x")).persist()
        n, p = x.count(), len(names)
        solve = self._of_products if n < p else self._of_covariance
        values, vectors, ratio, mean = solve(x, n, p)
        k = len(vectors)
        self.components_, self.explained_variance_, self.explained_variance_ratio_ = vectors[:k], values[:k], ratio[:k]
        loadings = vectors[:k] / np.sqrt(np.maximum(values[:k], 1e-300))[:, None] if self.whiten else vectors[:k]
        columns = []
        for i, row in enumerate(loadings):
            dot = F.aggregate(F.zip_with("x", F.array(*map(F.lit, row.tolist())), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
            columns.append((dot - float(row @ mean)).alias(f"pc_{i}"))
        return x.select("slice_id", *columns)

    def _wanted(self, values: np.ndarray, total: float) -> tuple[int, np.ndarray]:
        """How many components to keep, and the shares of variance of all."""
        ratio = values / max(total, 1e-300)
        if isinstance(self.n_components, float) and 0 < self.n_components < 1:
            return min(len(values), int(np.searchsorted(np.cumsum(ratio), self.n_components) + 1)), ratio
        return len(values) if self.n_components is None else min(len(values), int(self.n_components)), ratio

    def _of_covariance(self, x: DataFrame, n: int, p: int):
        """Variances, components, shares of variance and means from a table of features by features."""

        def partial(frames):
            sums = np.zeros((p + 1, p + 1))  # products of a partition's vectors, and their sums as the last row
            for frame in frames:
                block = np.column_stack([_matrix(frame, p), np.ones(len(frame))])
                sums += block.T @ block
            yield pd.DataFrame({"i": np.arange(p + 1), "sums": list(sums)})

        table = _added(x.select("x").mapInPandas(partial, "i int, sums array<double>"), p + 1, p + 1)
        mean = table[p, :p] / max(n, 1)
        covariance = (table[:p, :p] - n * np.outer(mean, mean)) / max(n - 1, 1)
        values, vectors = np.linalg.eigh(covariance)
        order = np.argsort(-values)[: min(n, p)]
        values, vectors = np.maximum(values[order], 0), vectors[:, order].T
        k, ratio = self._wanted(values, float(np.trace(covariance)))
        return values, _turned(vectors[:k]), ratio, mean

    def _of_products(self, x: DataFrame, n: int, p: int):
        """The same from a table of slices by slices; no task or message holds features by features."""

        def total(frames):
            sums = np.zeros(p)
            for frame in frames:
                sums += _matrix(frame, p).sum(axis=0)
            yield pd.DataFrame({"i": [0], "sums": [sums]})

        mean = _added(x.select("x").mapInPandas(total, "i int, sums array<double>"), 1, p)[0] / max(n, 1)

        def products(_, own: dict, other: dict) -> dict:
            rows, columns = (np.stack(side["x"]) - mean for side in (own, other))
            return {"slice_id": own["slice_id"].astype(np.int32), "others": pa.array([other["slice_id"].astype(np.int32)] * len(rows)), "v": pa.array(list(rows @ columns.T))}

        ids = sorted(r["slice_id"] for r in x.select("slice_id").collect())  # fewer than there are feature names
        place = {s: i for i, s in enumerate(ids)}
        table = np.zeros((n, n))
        for r in reduced(x, None, products, "slice_id int, others array<int>, v array<double>").toLocalIterator():
            table[place[r["slice_id"]], [place[s] for s in r["others"]]] = r["v"]
        values, turns = np.linalg.eigh(table)
        values, turns = values[::-1], turns[:, ::-1]
        k, ratio = self._wanted(np.maximum(values, 0), float(np.trace(table)))
        varies = values > n * np.finfo(float).eps * max(float(values[0]) if n else 0.0, 0.0)
        scale = np.where(varies, 1 / np.sqrt(np.where(varies, values, 1.0)), 0.0)
        weight = turns[:, :k] * scale[:k]  # a component is this sum of slices

        def combined(frames):
            sums = np.zeros((k, p))
            for frame in frames:
                at = [place[s] for s in frame["slice_id"]]
                sums += weight[at].T @ (_matrix(frame, p) - mean)
            yield pd.DataFrame({"i": np.arange(k), "sums": list(sums)})

        vectors = _added(x.mapInPandas(combined, "i int, sums array<double>"), k, p)
        return np.maximum(values, 0) / max(n - 1, 1), _turned(vectors), ratio, mean


def _matrix(frame: pd.DataFrame, p: int) -> np.ndarray:
    return np.array(frame["x"].tolist(), float).reshape(-1, p)


def _added(parts: DataFrame, rows: int, columns: int) -> np.ndarray:
    """The table whose row i is the sum of all sums of i; partitions are added up in tasks, so that one table reaches the driver."""

    def added(frame):
        return pd.DataFrame({"i": [frame["i"].iloc[0]], "sums": [np.sum(frame["sums"].tolist(), axis=0)]})

    table = np.zeros((rows, columns))
    for r in parts.groupBy("i").applyInPandas(added, "i int, sums array<double>").collect():
        table[r["i"]] = r["sums"]
    return table


def _turned(vectors: np.ndarray) -> np.ndarray:
    """Each row with the sign that makes its entry of largest size positive."""
    return vectors * np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])[:, None]
