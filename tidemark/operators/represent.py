"""Representation models: how much of the horizon each selected slice stands for.

weigh gives the long form slice_id, rep_slice_id, weight; slice_id is null where a weight
belongs to the representative alone.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.kernels import simplex_weights
from tidemark.plans.context import ProblemContext


class RepresentationModel(ABC):
    def fit(self, context: ProblemContext) -> None:
        self.context = context

    def _reps(self, combination: tuple[str, ...]) -> DataFrame:
        """rep_slice_id and pos of a selection given by labels; unknown labels are refused."""
        spark = self.context.slices.sparkSession
        named = spark.createDataFrame([(s, i) for i, s in enumerate(combination)], "slice_label string, pos int")
        found = named.join(self.context.slices.select(F.col("slice_id").alias("rep_slice_id"), "slice_label"), "slice_label")
        if found.count() != len(combination):
            raise ValueError("the selection holds unknown slices")
        return found.select("rep_slice_id", "pos")

    @abstractmethod
    def weigh(self, combination: tuple[str, ...]) -> DataFrame: ...


class UniformRepresentationModel(RepresentationModel):
    """The same weight for each."""

    def weigh(self, combination):
        reps = self._reps(combination)
        return reps.select(F.lit(None).cast("int").alias("slice_id"), "rep_slice_id", F.lit(1.0 / max(len(combination), 1)).alias("weight"))


class KMedoidsClustersizeRepresentation(RepresentationModel):
    """Share of slices that are nearest to each; 0 for a representative without slices."""

    def weigh(self, combination):
        reps = F.broadcast(self._reps(combination))
        d = self.context.distances_to(reps.withColumnRenamed("rep_slice_id", "slice_id"))
        near = d.join(reps, F.col("j") == F.col("rep_slice_id")).groupBy("i").agg(F.min_by("rep_slice_id", F.struct("d", "pos")).alias("rep_slice_id"))
        shares = near.groupBy("rep_slice_id").agg(F.count(F.lit(1)).alias("n"))
        total = self.context.slices.count()
        joined = reps.select("rep_slice_id").join(shares, "rep_slice_id", "left")
        return joined.select(F.lit(None).cast("int").alias("slice_id"), "rep_slice_id", (F.coalesce("n", F.lit(0)) / F.lit(total)).alias("weight"))


class BlendedRepresentationModel(RepresentationModel):
    """Each slice as the convex mix of representatives that is nearest to it in feature space."""

    def __init__(self, blend_type: str = "convex"):
        if blend_type != "convex":
            raise NotImplementedError(f"blend type {blend_type!r}")

    def weigh(self, combination):
        x = self.context.feature_vectors()
        reps = self._reps(combination).join(x.withColumnRenamed("slice_id", "rep_slice_id"), "rep_slice_id").orderBy("pos").collect()
        vertices = np.array([r["x"] for r in reps], float)
        ids = [r["rep_slice_id"] for r in reps]

        def blend(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if ids and len(frame):
                    found = np.concatenate([simplex_weights(np.asarray(z, float), vertices) for z in frame["x"]])
                    yield pd.DataFrame({"slice_id": np.repeat(frame["slice_id"].to_numpy(), len(ids)), "rep_slice_id": np.tile(ids, len(frame)), "weight": found})

        return x.mapInPandas(blend, "slice_id int, rep_slice_id int, weight double")


def aggregated(weights: DataFrame) -> DataFrame:
    """rep_slice_id and weight: the long form's weights summed and scaled to 1."""
    total = weights.groupBy("rep_slice_id").agg(F.sum("weight").alias("w"))
    return total.crossJoin(F.broadcast(total.agg(F.sum("w").alias("all")))).select("rep_slice_id", F.try_divide("w", "all").alias("weight"))
