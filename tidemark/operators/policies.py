"""Objectives, and policies that pick one candidate from a table of scores."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.order import quantiles, value_grid
from tidemark.functions.skyline import undominated
from tidemark.operators.combos import members_of
from tidemark.operators.scores import ScoreComponent
from tidemark.plans.context import ProblemContext
from tidemark.sources.tables import stored


@dataclass(frozen=True)
class ObjectiveSpec:
    component: ScoreComponent
    weight: float = 1.0


class ObjectiveSet:
    """Weighted score components, keyed by the components' names."""

    def __init__(self, weighted_score_components: dict[str, tuple[float, ScoreComponent] | ObjectiveSpec]):
        self.specs: dict[str, ObjectiveSpec] = {}
        for value in weighted_score_components.values():
            spec = value if isinstance(value, ObjectiveSpec) else ObjectiveSpec(value[1], value[0])
            if spec.weight < 0:
                raise ValueError("weights must not be negative")
            if spec.component.direction not in ("min", "max"):
                raise ValueError("a direction is 'min' or 'max'")
            if spec.component.name in self.specs:
                raise ValueError(f"two components are named {spec.component.name!r}")
            self.specs[spec.component.name] = spec

    def prepare(self, context: ProblemContext) -> None:
        for spec in self.specs.values():
            spec.component.prepare(context)

    def evaluate_all(self, combos: DataFrame) -> DataFrame:
        """combos with a column of scores for each component."""
        combos = stored(combos, "combos")
        members, out = members_of(combos), combos
        for name, spec in self.specs.items():
            out = out.join(stored(spec.component.score_all(members).withColumnRenamed("score", name), "scores"), "combo_id", "left")
        return out

    def evaluate(self, combination: tuple[str, ...]) -> dict[str, float]:
        return {name: spec.component.score(combination) for name, spec in self.specs.items()}

    def component_meta(self) -> dict[str, dict[str, Any]]:
        return {n: {"direction": s.component.direction, "pref": s.weight} for n, s in self.specs.items()}


@dataclass(frozen=True)
class PolicyOutcome:
    selected: Any
    scores: dict[str, float] = field(default_factory=dict)


@dataclass(frozen=True)
class ParetoOutcome:
    selected: Any
    front: DataFrame | None = None


def oriented(df: DataFrame, meta: dict[str, dict[str, Any]]) -> DataFrame:
    """Columns _y_name, smaller being better; NaN is null."""
    return df.withColumns({f"_y_{n}": F.nanvl(F.col(n), F.lit(None).cast("double")) * (-1.0 if m["direction"] == "max" else 1.0) for n, m in meta.items()})


def normalised(df: DataFrame, names: list[str], mode: str) -> DataFrame:
    """Columns _z_name from _y_name: none, robust_minmax or zscore_iqr over all rows."""
    if mode == "none":
        return df.withColumns({f"_z_{n}": F.col(f"_y_{n}") for n in names})
    if mode not in ("robust_minmax", "zscore_iqr"):
        raise ValueError(f"unknown normalisation {mode!r}")
    points = (0.05, 0.95) if mode == "robust_minmax" else (0.25, 0.5, 0.75)
    long = df.unpivot([], [f"_y_{n}" for n in names], "name", "value").where("value is not null")
    found = quantiles(value_grid(long.withColumn("n", F.lit(1)), "name"), points, "name")
    whole = found.groupBy().pivot("name", [f"_y_{n}" for n in names]).agg(F.first("q"))  # one row
    whole = whole.select(*[F.col(f"`_y_{n}`").alias(f"_q_{n}") for n in names])
    out = df.crossJoin(F.broadcast(whole))
    columns = {}
    for n in names:
        q, y = F.col(f"_q_{n}"), F.col(f"_y_{n}")
        width = q[len(points) - 1] - q[0]
        width = F.when(width == 0, 1.0).otherwise(width)
        columns[f"_z_{n}"] = F.greatest((y - q[0]) / width, F.lit(0.0)) if mode == "robust_minmax" else (y - q[1]) / width
    return out.withColumns(columns).drop(*[f"_q_{n}" for n in names])


class SelectionPolicy(ABC):
    """Ranks candidates; rank_all adds what the choice rests on, select_best takes one row."""

    tie_breakers: tuple[str, ...] = ()
    tie_dirs: tuple[str, ...] = ()

    @abstractmethod
    def rank_all(self, evaluations: DataFrame, objectives: ObjectiveSet) -> DataFrame:
        """evaluations with policy_score, smaller being better, and other columns of the policy."""

    def select_best(self, evaluations: DataFrame, objectives: ObjectiveSet):
        """The best row: by policy_score, then the tie breakers in turn, then combo_id."""
        ties = [F.col(c).desc_nulls_last() if d == "max" else F.col(c).asc_nulls_last() for c, d in zip(self.tie_breakers, self.tie_dirs, strict=False)]
        ranked = self.rank_all(evaluations, objectives)
        return ranked.orderBy(*self._first(ranked), F.col("policy_score").asc_nulls_last(), *ties, "combo_id").limit(1)

    def _first(self, ranked: DataFrame) -> list:
        return []


class WeightedSumPolicy(SelectionPolicy):
    """Smallest weighted sum of oriented, normalised scores."""

    def __init__(self, overrides: dict[str, float] | None = None, normalization: str = "none", tie_breakers: tuple[str, ...] = (), tie_dirs: tuple[str, ...] = ()):
        self.overrides, self.normalization = overrides or {}, normalization
        self.tie_breakers, self.tie_dirs = tie_breakers, tie_dirs

    def rank_all(self, evaluations, objectives):
        meta = objectives.component_meta()
        unknown = set(self.overrides) - set(meta)
        if unknown:
            raise ValueError(f"weights for unknown scores: {sorted(unknown)}")
        z = normalised(oriented(evaluations, meta), list(meta), self.normalization)
        total = sum((F.col(f"_z_{n}") * float(self.overrides.get(n, m["pref"])) for n, m in meta.items()), F.lit(0.0))
        return z.withColumn("policy_score", total).select(*evaluations.columns, "policy_score")


def with_front(df: DataFrame, names: list[str], eps: float = 1e-9) -> DataFrame:
    """df with pareto_mask: feasible rows that no feasible row dominates in the columns _y_name.

    a dominates b if it is at most b + eps everywhere and less than b - eps somewhere. Nulls
    are never dominated nor dominate.
    """
    columns = [f"_y_{n}" for n in names]
    complete = reduce(lambda p, q: p & q, [F.col(c).isNotNull() for c in columns], F.col("feasible_mask"))
    rows = df.where(complete).select(F.col("combo_id").alias("id"), *[F.col(c).cast("double").alias(c) for c in columns]).transform(stored, "points")
    left = undominated(rows, columns, eps).select(F.col("id").alias("combo_id"))
    incomplete = df.where(F.col("feasible_mask") & ~complete).select("combo_id")
    front = left.unionByName(incomplete).withColumn("pareto_mask", F.lit(True))
    return df.join(front, "combo_id", "left").withColumn("pareto_mask", F.coalesce("pareto_mask", F.lit(False)))


class ParetoUtopiaPolicy(SelectionPolicy):
    """The candidate of the Pareto front nearest to the utopia point.

    Feasible are candidates whose raw scores are at most their constraints. Without a front
    the nearest feasible candidate is taken, without a feasible one the nearest of all.
    """

    def __init__(self, objectives: list[str] | None = None, normalization: str = "robust_minmax", fairness_constraints: dict[str, float] | None = None, distance: str = "chebyshev", tie_breakers: tuple[str, ...] = (), tie_dirs: tuple[str, ...] = (), eps: float = 1e-9):
        if distance not in ("chebyshev", "euclidean"):
            raise ValueError(f"unknown distance {distance!r}")
        self.objectives, self.normalization, self.constraints = objectives, normalization, fairness_constraints or {}
        self.distance, self.tie_breakers, self.tie_dirs, self.eps = distance, tie_breakers, tie_dirs, eps

    def _masked(self, evaluations: DataFrame, objectives: ObjectiveSet) -> tuple[DataFrame, list[str]]:
        meta = objectives.component_meta()
        names = self.objectives or list(meta)
        unknown = (set(self.constraints) | set(names)) - set(evaluations.columns)
        if unknown:
            raise ValueError(f"unknown scores: {sorted(unknown)}")
        feasible = reduce(lambda p, q: p & q, [F.col(c) <= t for c, t in self.constraints.items()], F.lit(True))
        df = oriented(evaluations, {n: meta[n] for n in names}).withColumn("feasible_mask", F.coalesce(feasible, F.lit(False)))
        z = normalised(with_front(stored(df, "oriented"), names, self.eps), names, self.normalization)
        ideal = z.where("feasible_mask").agg(*[F.min(f"_z_{n}").alias(f"_i_{n}") for n in names])
        return z.crossJoin(F.broadcast(ideal)), names  # one row

    def _score(self, names: list[str]):
        gaps = [F.abs(F.col(f"_z_{n}") - F.coalesce(F.col(f"_i_{n}"), F.lit(0.0))) for n in names]
        if self.distance == "chebyshev":
            return F.greatest(*gaps) if len(gaps) > 1 else gaps[0]
        return F.sqrt(sum((g * g for g in gaps), F.lit(0.0)))

    def rank_all(self, evaluations, objectives):
        z, names = self._masked(evaluations, objectives)
        return z.withColumn("policy_score", self._score(names)).select(*evaluations.columns, "feasible_mask", "pareto_mask", "policy_score")

    def _first(self, ranked):
        return [F.col("pareto_mask").desc(), F.col("feasible_mask").desc()]


class ParetoMaxMinStrategy(ParetoUtopiaPolicy):
    """The candidate of the front whose worst objective is best: it maximises the least 1 - (z - ideal)."""

    def _score(self, names):
        slack = [1 - (F.col(f"_z_{n}") - F.coalesce(F.col(f"_i_{n}"), F.lit(0.0))) for n in names]
        return -(F.least(*slack) if len(slack) > 1 else slack[0])
