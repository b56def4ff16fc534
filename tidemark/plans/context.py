"""Slicing a series into candidate periods, and the context that the pillars share."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, NumericType

from tidemark.functions.blocks import pairs
from tidemark.functions.order import quantiles, value_grid
from tidemark.sources.tables import stored

UNITS = ("year", "month", "week", "day", "hour")
_LABELS = {"year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd", "hour": "yyyy-MM-dd HH:mm:ss"}


class TimeSlicer:
    """Assigns timestamps to calendar periods of one unit; weeks run from Monday to Sunday."""

    def __init__(self, unit: str):
        self.unit = unit

    def _checked(self) -> str:
        if self.unit not in UNITS:
            raise ValueError(f"unknown slice unit {self.unit!r}; use one of {UNITS}")
        return self.unit

    def slice_start(self, ts: Column) -> Column:
        """First moment of the period that ts lies in."""
        return F.date_trunc(self._checked(), ts).cast("timestamp_ntz")

    def slice_label(self, start: Column) -> Column:
        """Text of a period given by its start; weeks as first and last day."""
        if self._checked() == "week":
            last = F.date_add(start.cast("date"), 6)
            return F.concat_ws("/", F.date_format(start, "yyyy-MM-dd"), F.date_format(last, "yyyy-MM-dd"))
        return F.date_format(start, _LABELS[self.unit])

    def labels_for_index(self, df: DataFrame, ts_col: str = "ts") -> DataFrame:
        """df with slice_start and slice_label."""
        start = self.slice_start(F.col(ts_col))
        return df.withColumn("slice_start", start).withColumn("slice_label", self.slice_label(F.col("slice_start")))

    def unique_slices(self, df: DataFrame, ts_col: str = "ts") -> DataFrame:
        """slice_id, slice_start, slice_label and n_rows of the periods present, numbered from 0 in time order."""
        return self.numbered(df.select(self.slice_start(F.col(ts_col)).alias("slice_start")))

    def numbered(self, starts: DataFrame) -> DataFrame:
        """The same from a column slice_start of all rows."""
        found = starts.groupBy("slice_start").agg(F.count(F.lit(1)).alias("n_rows")).where("slice_start is not null")
        # one row per calendar period is left here, so that one task can number them
        number = F.row_number().over(Window.orderBy("slice_start")) - 1
        return found.select(number.cast("int").alias("slice_id"), "slice_start", self.slice_label(F.col("slice_start")).alias("slice_label"), "n_rows")

    def get_indices_for_slice_combi(self, df: DataFrame, selection: Any, ts_col: str = "ts") -> DataFrame:
        """Timestamps of the rows in one period or several, given by label."""
        labels = [selection] if isinstance(selection, str) else list(selection)
        return self.labels_for_index(df, ts_col).where(F.col("slice_label").isin(labels)).select(ts_col)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _cosine(a: str, b: str) -> Column:
    product, one, two = (_sum(F.zip_with(x, y, lambda p, q: p * q)) for x, y in ((a, b), (a, a), (b, b)))
    return F.greatest(1 - F.coalesce(F.try_divide(product, F.sqrt(one) * F.sqrt(two)), F.lit(0.0)), F.lit(0.0))


#: Distances of two arrays of features.
METRICS = {
    "euclidean": lambda a, b: F.sqrt(_sum(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)))),
    "sqeuclidean": lambda a, b: _sum(F.zip_with(a, b, lambda p, q: (p - q) * (p - q))),
    "manhattan": lambda a, b: _sum(F.zip_with(a, b, lambda p, q: F.abs(p - q))),
    "chebyshev": lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: F.abs(p - q)), F.lit(0.0), lambda s, v: F.greatest(s, v)),
    "cosine": _cosine,
}
METRICS |= {"l2": METRICS["euclidean"], "l1": METRICS["manhattan"], "cityblock": METRICS["manhattan"]}


def _distances(one: DataFrame, two: DataFrame, metric: str = "euclidean") -> DataFrame:
    return one.alias("a").crossJoin(two.alias("b")).select(F.col("a.slice_id").alias("i"), F.col("b.slice_id").alias("j"), METRICS[metric]("a.x", "b.x").alias("d"))


@dataclass(frozen=True)
class ProblemContext:
    """A series with its slicer, and features once they are computed. Never changed in place.

    df is wide; NaN counts as null. Columns that are not numeric are left out.
    """

    df: DataFrame
    slicer: TimeSlicer
    ts_col: str = "ts"
    metadata: dict[str, Any] = field(default_factory=dict)
    df_features: DataFrame | None = None
    chunk: int = 4096  # distinct values of a variable that scores compare at once

    @cached_property
    def variables(self) -> list[str]:
        return [f.name for f in self.df.schema.fields if f.name != self.ts_col and isinstance(f.dataType, NumericType)]

    @cached_property
    def _series(self) -> DataFrame:
        """ts, slice_start and the variables as doubles without NaN; computed once, whatever reads it."""
        kinds = {f.name: f.dataType for f in self.df.schema.fields}
        values = [(F.nanvl(F.col(c), F.lit(None).cast("double")) if isinstance(kinds[c], DoubleType) else F.col(c).cast("double")).alias(c) for c in self.variables]
        plain = self.df.select(F.col(self.ts_col).alias("ts"), self.slicer.slice_start(F.col(self.ts_col)).alias("slice_start"), *values)
        return stored(plain, "series")

    @cached_property
    def slices(self) -> DataFrame:
        return stored(self.slicer.numbered(self._series.select("slice_start")), "slices")

    @cached_property
    def rows(self) -> DataFrame:
        """ts, slice_id and the variables as doubles without NaN."""
        return self._series.join(self.slices.select("slice_id", "slice_start"), "slice_start").drop("slice_start")

    @cached_property
    def observations(self) -> DataFrame:
        """Long form: slice_id, ts, variable, value; nulls are left out."""
        return self.rows.unpivot(["slice_id", "ts"], self.variables, "variable", "value").where("value is not null")

    @cached_property
    def value_counts(self) -> DataFrame:
        """slice_id, variable, value, n: all that distribution scores need of the series."""
        return self.observations.groupBy("slice_id", "variable", "value").agg(F.count(F.lit(1)).alias("n")).transform(stored, "values")

    @cached_property
    def grid(self) -> DataFrame:
        """The distinct values of each variable in order: variable, value, n, at, before, total; computed once for all scores."""
        return value_grid(self.value_counts)

    @cached_property
    def spread(self) -> DataFrame:
        """variable and spread, the range between its quartiles, 1 where it is 0."""
        width = F.col("q")[1] - F.col("q")[0]
        return quantiles(self.grid, [0.25, 0.75]).select("variable", F.when(width == 0, 1.0).otherwise(width).alias("spread")).transform(stored, "spread")

    @cached_property
    def held(self) -> DataFrame:
        """slice_id, variable, chunk, held (at, n), here, below and rows: a slice's values in each chunk of the grid.

        here counts its rows in the chunk, below those in earlier chunks, rows all of the slice. A slice has a
        row for every chunk of the variable, with held null where it has no value.
        """
        chunk = F.expr(f"at div {self.chunk}").alias("chunk")
        counts = self.value_counts.join(self.grid.select("variable", "value", "at"), ["variable", "value"])
        found = counts.groupBy("slice_id", "variable", chunk).agg(F.collect_list(F.struct("at", "n")).alias("held"), F.sum("n").alias("here"))
        chunks = self.grid.groupBy("variable").agg(F.max(chunk).alias("last")).select("variable", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("chunk"))
        every = found.select("slice_id", "variable").distinct().join(F.broadcast(chunks), "variable").join(found, ["slice_id", "variable", "chunk"], "left")
        below = Window.partitionBy("slice_id", "variable").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        every = every.withColumn("here", F.coalesce("here", F.lit(0))).withColumn("below", F.coalesce(F.sum("here").over(below), F.lit(0)))
        return every.withColumn("rows", F.sum("here").over(Window.partitionBy("slice_id", "variable"))).transform(stored, "held")

    @property
    def features(self) -> DataFrame:
        if self.df_features is None:
            raise ValueError("no features: run a feature engineer first")
        return self.df_features

    @property
    def feature_columns(self) -> list[str]:
        return [c for c in self.features.columns if c != "slice_id"]

    def feature_vectors(self) -> DataFrame:
        """slice_id and x, the features as an array; a null feature is refused."""
        vectors = self.features.select("slice_id", F.array(*[F.col(f"`{c}`").cast("double") for c in self.feature_columns]).alias("x"))
        checked = F.when(F.exists("x", lambda v: v.isNull()), F.raise_error(F.lit("a feature is null; distances need complete features"))).otherwise(F.col("x"))
        return vectors.select("slice_id", checked.alias("x"))

    @cached_property
    def distances(self) -> DataFrame:
        """i, j and d, the Euclidean distance of features, for all pairs of slices; for readers that need every pair."""
        return stored(pairs(self.feature_vectors(), "euclidean"), "distances")

    def distances_to(self, selected: DataFrame) -> DataFrame:
        """i, j and d from every slice to those in selected (slice_id) alone."""
        x = self.feature_vectors()
        return _distances(x, x.join(F.broadcast(selected.select("slice_id")), "slice_id", "left_semi"))

    def with_features(self, features: DataFrame) -> ProblemContext:
        """A new context with one row of features per slice; a slice without features is refused."""
        missing = self.slices.join(features, "slice_id", "left_anti")
        if not missing.isEmpty():
            raise ValueError("features are missing for some slices")
        return replace(self, df_features=features)

    def copy(self) -> ProblemContext:
        return replace(self, metadata=dict(self.metadata))

    def get_unique_slices(self) -> list[str]:
        return [r["slice_label"] for r in self.slices.orderBy("slice_id").select("slice_label").collect()]

    def get_sliced_data(self, slice_label: str) -> DataFrame:
        raise NotImplementedError("use rows or a join with slices")
