"""The tables behind diagnostic charts; each returns a DataFrame that any plotting library can draw."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tidemark.functions.kernels import kendall_tau
from tidemark.functions.order import numbered_in_order
from tidemark.operators.policies import ObjectiveSet
from tidemark.plans.context import ProblemContext


def _checked(context: ProblemContext, columns: list[str]) -> None:
    missing = [c for c in columns if c not in context.features.columns]
    if missing:
        raise KeyError(f"no features {missing}")


def feature_scatter(context: ProblemContext, dimensions: list[str], selection: tuple[str, ...] = (), color: str | None = None) -> DataFrame:
    """Two or three features per slice, or more for a matrix, with label and is_selected; selected slices come last."""
    if not dimensions:
        raise ValueError("no dimensions")
    _checked(context, [*dimensions, *([color] if color else [])])
    columns = dict.fromkeys([*dimensions, *([color] if color else [])])
    joined = context.features.join(context.slices.select("slice_id", "slice_label"), "slice_id")
    return joined.select("slice_id", "slice_label", *columns, F.col("slice_label").isin(list(selection)).alias("is_selected")).orderBy("is_selected", "slice_id")


def selection_comparison(context: ProblemContext, dimensions: list[str], selections: dict[str, tuple[str, ...]]) -> DataFrame:
    """Features of the members of up to four named selections."""
    if not 1 <= len(selections) <= 4:
        raise ValueError("compare one to four selections")
    _checked(context, dimensions)
    rows = [(name, s) for name, labels in selections.items() for s in labels]
    named = context.slices.sparkSession.createDataFrame(rows, "selection string, slice_label string")
    return named.join(context.slices.select("slice_id", "slice_label"), "slice_label").join(context.features.select("slice_id", *dimensions), "slice_id")


def pca_variance(context: ProblemContext, engineer) -> DataFrame:
    """component, ratio and cumulative of a fitted PCA engineer."""
    if engineer.explained_variance_ratio_ is None:
        raise ValueError("the engineer is not fitted")
    rows = [(i, float(r)) for i, r in enumerate(engineer.explained_variance_ratio_)]
    table = context.slices.sparkSession.createDataFrame(rows, "component int, ratio double")
    return table.withColumn("cumulative", F.sum("ratio").over(Window.orderBy("component")))


def _long_features(context: ProblemContext, columns: list[str] | None) -> DataFrame:
    names = columns or context.feature_columns
    _checked(context, names)
    return context.features.unpivot(["slice_id"], names, "feature", "value").where("value is not null")


def _kendall(long: DataFrame, lower: bool) -> DataFrame:
    """a, b and r, Kendall's tau-b of every pair of features; a pair is one row of two arrays, counted in n log n."""
    rows = long.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("slice_id", "value"))).alias("rows"))
    known = rows.select("feature", F.transform("rows", lambda r: r["value"]).alias("v"))
    names = known.agg(F.collect_list("feature").alias("b"))  # one row
    sent = known.select(F.col("feature").alias("a"), F.col("v").alias("x")).crossJoin(F.broadcast(names)).withColumn("b", F.explode("b"))
    if lower:
        sent = sent.where("a > b")
    both = sent.join(known.select(F.col("feature").alias("b"), F.col("v").alias("y")), "b")

    @pandas_udf("double")
    def tau(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([kendall_tau(np.asarray(p, float), np.asarray(q, float)) for p, q in zip(x, y, strict=True)], dtype=float)

    return both.select("a", "b", tau("x", "y").alias("r")).select("a", "b", F.nanvl("r", F.lit(None).cast("double")).alias("r"))


def feature_correlation(context: ProblemContext, columns: list[str] | None = None, method: str = "pearson", lower: bool = False) -> DataFrame:
    """a, b and r for pairs of features: pearson, spearman (of average ranks) or kendall (tau-b)."""
    long = _long_features(context, columns)
    if method == "spearman":
        per = Window.partitionBy("feature")
        rank = F.rank().over(per.orderBy("value"))
        ties = F.count(F.lit(1)).over(Window.partitionBy("feature", "value"))
        long = long.select("slice_id", "feature", (rank + (ties - 1) / 2).alias("value"))
    elif method not in ("pearson", "kendall"):
        raise ValueError(f"unknown method {method!r}")
    if method == "kendall":
        return _kendall(long, lower)
    a = long.select("slice_id", F.col("feature").alias("a"), F.col("value").alias("x"))
    b = long.select("slice_id", F.col("feature").alias("b"), F.col("value").alias("y"))
    both = a.join(b, "slice_id")
    if lower:
        both = both.where("a > b")
    moments = both.groupBy("a", "b").agg(F.covar_pop("x", "y").alias("xy"), F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"))
    return moments.select("a", "b", F.try_divide("xy", F.sqrt("xx") * F.sqrt("yy")).alias("r"))


def histogram(values: DataFrame, by: list[str], bins: int = 20, norm: str = "") -> DataFrame:
    """by, bin (from 0), low, high and height over a column value; norm '', probability, percent or density.

    Bins are equal parts of each group's range; a group of one value has one bin.
    """
    if bins <= 0:
        raise ValueError("bins must be positive")
    if norm not in ("", "probability", "percent", "density"):
        raise ValueError(f"unknown norm {norm!r}")
    bounds = values.groupBy(*by).agg(F.min("value").alias("_low"), F.max("value").alias("_high"), F.count("value").alias("_n"))
    width = (F.col("_high") - F.col("_low")) / bins
    place = F.when(F.col("_high") == F.col("_low"), 0).otherwise(F.least(F.floor((F.col("value") - F.col("_low")) / width), F.lit(bins - 1))).cast("int")
    counts = values.join(F.broadcast(bounds), by).groupBy(*by, "_low", "_high", "_n", place.alias("bin")).agg(F.count(F.lit(1)).alias("height"))
    step = (F.col("_high") - F.col("_low")) / bins
    height = {"": F.col("height").cast("double"), "probability": F.col("height") / F.col("_n"), "percent": 100 * F.col("height") / F.col("_n"), "density": F.try_divide(F.col("height") / F.col("_n"), step)}[norm]
    return counts.select(*by, "bin", (F.col("_low") + F.col("bin") * step).alias("low"), (F.col("_low") + (F.col("bin") + 1) * step).alias("high"), height.alias("height"))


def feature_distributions(context: ProblemContext, columns: list[str] | None = None, bins: int = 20) -> DataFrame:
    return histogram(_long_features(context, columns), ["feature"], bins)


def _with_source(context: ProblemContext, selection: tuple[str, ...], variables: list[str] | None) -> DataFrame:
    """source (full or selection), variable, value."""
    names = variables or context.variables
    full = context.observations.where(F.col("variable").isin(names))
    chosen = F.broadcast(context.slices.where(F.col("slice_label").isin(list(selection))).select("slice_id"))  # one row per member
    own = full.join(chosen, "slice_id", "left_semi")
    return full.select(F.lit("full").alias("source"), "variable", "value").unionByName(own.select(F.lit("selection").alias("source"), "variable", "value"))


def ecdf(context: ProblemContext, selection: tuple[str, ...], variables: list[str] | None = None) -> DataFrame:
    """source, variable, value and p, one step per row; of one variable or a grid of several."""
    rows = numbered_in_order(_with_source(context, selection, variables), ["source", "variable", "value"], "place")
    whole = rows.groupBy("source", "variable").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    joined = rows.join(F.broadcast(whole), ["source", "variable"])  # two rows per variable
    return joined.select("source", "variable", "value", ((F.col("place") - F.col("first") + 1) / F.col("n")).alias("p"))


def distribution_histogram(context: ProblemContext, selection: tuple[str, ...], variables: list[str] | None = None, bins: int = 20, norm: str = "probability") -> DataFrame:
    return histogram(_with_source(context, selection, variables), ["source", "variable"], bins, norm)


def correlation_difference(context: ProblemContext, selection: tuple[str, ...]) -> DataFrame:
    """a, b and difference: the selection's correlation less that of the whole series."""
    names = context.variables
    chosen = F.broadcast(context.slices.where(F.col("slice_label").isin(list(selection))).select("slice_id"))  # one row per member

    def matrix(rows: DataFrame) -> DataFrame:
        out = []
        for a in names:
            for b in names:
                both = F.col(a).isNotNull() & F.col(b).isNotNull()
                spread = F.sqrt(F.var_pop(F.when(both, F.col(a)))) * F.sqrt(F.var_pop(F.when(both, F.col(b))))
                out.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.try_divide(F.covar_pop(a, b), spread).alias("r")))
        return rows.agg(F.array(*out).alias("m")).select(F.inline("m"))

    full, own = matrix(context.rows), matrix(context.rows.join(chosen, "slice_id", "left_semi"))
    return full.withColumnRenamed("r", "r_full").join(own, ["a", "b"]).select("a", "b", (F.col("r") - F.col("r_full")).alias("difference"))


def diurnal_profiles(context: ProblemContext, selection: tuple[str, ...]) -> DataFrame:
    """source, variable, hour and the mean value."""
    chosen = F.broadcast(context.slices.where(F.col("slice_label").isin(list(selection))).select("slice_id"))  # one row per member
    own = context.observations.join(chosen, "slice_id", "left_semi").withColumn("source", F.lit("selection"))
    rows = context.observations.withColumn("source", F.lit("full")).unionByName(own)
    return rows.groupBy("source", "variable", F.hour("ts").alias("hour")).agg(F.avg("value").alias("mean"))


def responsibility(weights: DataFrame) -> DataFrame:
    """rep_slice_id, weight and uniform, the weight if all were equal."""
    if weights.isEmpty():
        raise ValueError("no weights")
    total = weights.groupBy("rep_slice_id").agg(F.sum("weight").alias("weight"))
    return total.withColumn("uniform", 1.0 / F.count(F.lit(1)).over(Window.partitionBy()))


def score_contributions(spark, scores: dict[str, float]) -> DataFrame:
    """score, value and share of the sum."""
    if not sum(scores.values()):
        raise ValueError("the scores sum to 0")
    table = spark.createDataFrame(list(scores.items()), "score string, value double")
    return table.withColumn("share", F.try_divide("value", F.sum("value").over(Window.partitionBy())))


def pareto_categories(ranked: DataFrame, objectives: ObjectiveSet, selected: int | None = None) -> DataFrame:
    """combo_id, label, the scores, category and status (0 infeasible, 1 dominated, 2 on the front).

    Serves the scatter of two objectives, the matrix of several and parallel coordinates.
    """
    names = list(objectives.specs)
    category = F.when(F.col("combo_id") == (-1 if selected is None else selected), "Selected").when(~F.col("feasible_mask"), "Infeasible").when(F.col("pareto_mask"), "Pareto").otherwise("Dominated")
    status = F.when(~F.col("feasible_mask"), 0).when(F.col("pareto_mask"), 2).otherwise(1)
    return ranked.select("combo_id", "label", *names, category.alias("category"), status.alias("status"))
