"""Candidate selections: combos (combo_id, slice_ids, label) in a fixed order.

Sets are built by joins: of ids with larger ids, of groups with groups. Counts are known in
closed form before anything runs. Candidates are numbered range by range of their order, and
labels are looked up in one row, so no task sees all candidates.
"""

from __future__ import annotations

import math
from abc import ABC, abstractmethod
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.order import numbered_in_order
from tidemark.plans.context import ProblemContext, TimeSlicer


def subsets(items: DataFrame, column: str, k: int) -> DataFrame:
    """All k-subsets of a column's values as ascending arrays in column chosen."""
    grown = items.select(F.array(column).alias("chosen"))
    for _ in range(k - 1):
        grown = grown.join(items.select(F.col(column).alias("_next")), F.col("_next") > F.element_at("chosen", -1)).select(F.concat("chosen", F.array("_next")).alias("chosen"))
    return grown


def unrank(numbers: np.ndarray, n: int, k: int) -> np.ndarray:
    """The k-subsets of range(n) with the given numbers in lexicographic order, one a row; by the combinatorial number system."""
    rest, low = np.asarray(numbers, np.int64).copy(), np.zeros(len(numbers), np.int64)
    out = np.zeros((len(rest), k), np.int64)
    for place in range(k):
        # sets that begin with less than e at this place, those before low taken off
        below = np.concatenate([[0], np.cumsum([math.comb(n - e - 1, k - place - 1) for e in range(n)])]).astype(np.int64)
        wanted = rest + below[low]
        out[:, place] = np.searchsorted(below, wanted, side="right") - 1
        rest = wanted - below[out[:, place]]
        low = out[:, place] + 1
    return out


SEASONS = ("winter", "spring", "summer", "fall")  # three months each, from December on


class CombinationGenerator(ABC):
    """Candidates of one kind over the slices of a context."""

    k: int

    def generate(self, context: ProblemContext) -> DataFrame:
        """combo_id (from 0), slice_ids (array<int>), label."""
        return self._labelled(context, numbered_in_order(self._chosen(context), ["slice_ids"], "combo_id"))

    @staticmethod
    def _labelled(context: ProblemContext, numbered: DataFrame) -> DataFrame:
        names = context.slices.agg(F.transform(F.array_sort(F.collect_list(F.struct("slice_id", "slice_label"))), lambda s: s["slice_label"]).alias("names"))
        label = F.array_join(F.transform("slice_ids", lambda i: F.col("names")[i]), ", ")
        return numbered.crossJoin(F.broadcast(names)).select("combo_id", "slice_ids", label.alias("label"))  # one row of names

    @abstractmethod
    def _chosen(self, context: ProblemContext) -> DataFrame:
        """slice_ids of every candidate."""

    @abstractmethod
    def count(self, context: ProblemContext) -> int:
        """Number of candidates."""

    @abstractmethod
    def combination_is_valid(self, combination: tuple[str, ...], context: ProblemContext) -> bool:
        """Whether labels form a candidate; repeated members never do."""


def members_of(combos: DataFrame) -> DataFrame:
    """combo_id, pos, slice_id: one row per member."""
    return combos.select("combo_id", F.posexplode("slice_ids").alias("pos", "slice_id"))


class ExhaustiveCombiGen(CombinationGenerator):
    """All sets of k slices."""

    def __init__(self, k: int):
        self.k = k

    def generate(self, context):
        """Candidate number i is unranked where it is needed: there is no join, no sort and no numbering."""
        numbers = context.slices.sparkSession.range(self.count(context)).select(F.col("id").alias("combo_id"))
        n, k = context.slices.count(), self.k

        def unranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = unrank(batch.column("combo_id").to_numpy(), n, k).astype(np.int32)
                offsets = np.arange(len(found) + 1, dtype=np.int32) * k
                yield pa.RecordBatch.from_arrays([batch.column("combo_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel()))], ["combo_id", "slice_ids"])

        return self._labelled(context, numbers.mapInArrow(unranked, "combo_id long, slice_ids array<int>"))

    def _chosen(self, context):
        return self.generate(context).select("slice_ids")

    def count(self, context):
        return math.comb(context.slices.count(), self.k) if self.k >= 1 else 0

    def combination_is_valid(self, combination, context):
        known = set(context.get_unique_slices())
        return len(combination) == self.k == len(set(combination)) and set(combination) <= known


class GroupQuotaCombiGen(CombinationGenerator):
    """Sets of k slices with a fixed number from each group."""

    def __init__(self, k: int, slice_to_group_mapping: dict[str, str], group_quota: dict[str, int]):
        if sum(group_quota.values()) != k:
            raise ValueError("group quotas must sum to k")
        self.k, self.mapping, self.quota = k, slice_to_group_mapping, group_quota

    def _grouped(self, context: ProblemContext) -> list[tuple[str, list[int]]]:
        found: dict[str, list[int]] = {g: [] for g in self.quota}
        for r in context.slices.select("slice_id", "slice_label").orderBy("slice_id").collect():
            group = self.mapping[r["slice_label"]]
            if group in found:
                found[group].append(r["slice_id"])
        return list(found.items())

    def _chosen(self, context):
        rows = [(g, i) for g, ids in self._grouped(context) for i in ids]
        return _quota_sets(context.slices.sparkSession, rows, "int", self.quota).withColumnRenamed("chosen", "slice_ids")

    def count(self, context):
        return math.prod(math.comb(len(ids), self.quota[g]) for g, ids in self._grouped(context))

    def combination_is_valid(self, combination, context):
        if len(combination) != self.k or len(set(combination)) != self.k:
            return False
        groups = [self.mapping.get(s) for s in combination]
        return all(groups.count(g) == q for g, q in self.quota.items())


def _quota_sets(spark, rows: list[tuple], kind: str, quota: dict[str, int]) -> DataFrame:
    """Sets with quota[g] items of each group g, as ascending arrays; rows are (group, item)."""
    items = spark.createDataFrame(rows, f"grp string, item {kind}").coalesce(1)  # one partition, so that products do not multiply partitions
    chosen = None
    for group, q in quota.items():
        if q:
            part = subsets(items.where(F.col("grp") == group), "item", q).withColumnRenamed("chosen", "part")
            joined = part.select(F.col("part").alias("chosen")) if chosen is None else chosen.crossJoin(part).select(F.concat("chosen", "part").alias("chosen"))
            chosen = joined.repartition(spark.sparkContext.defaultParallelism)
    if chosen is None:
        return items.limit(0).select(F.array("item").alias("chosen"))
    return chosen.select(F.array_sort("chosen").alias("chosen"))


class ExhaustiveHierarchicalCombiGen(CombinationGenerator):
    """All children of every set of parent_k parents."""

    def __init__(self, parent_k: int, slice_to_parent_mapping: dict[str, str]):
        self.k, self.parent_k, self.mapping = parent_k, parent_k, slice_to_parent_mapping

    @classmethod
    def from_slicers(cls, parent_k: int, df: DataFrame, child_slicer: TimeSlicer, parent_slicer: TimeSlicer, ts_col: str = "ts"):
        return cls(parent_k, parents_of(df, child_slicer, parent_slicer, ts_col))

    def _parents(self) -> list[str]:
        return sorted(set(self.mapping.values()))

    def _sets(self, spark) -> DataFrame:
        parents = spark.createDataFrame([(p,) for p in self._parents()], "parent string")
        return subsets(parents, "parent", self.parent_k)

    def _chosen(self, context):
        spark = context.slices.sparkSession
        children = spark.createDataFrame(list(self.mapping.items()), "slice_label string, parent string")
        known = children.join(context.slices.select("slice_id", "slice_label"), "slice_label")
        sets = self._sets(spark).select("chosen", F.explode("chosen").alias("parent"))
        return sets.join(known, "parent").groupBy("chosen").agg(F.array_sort(F.collect_list("slice_id")).alias("slice_ids")).select("slice_ids")

    def count(self, context):
        return math.comb(len(self._parents()), self.parent_k)

    def _parents_of(self, combination: tuple[str, ...]) -> set[str] | None:
        """The parents whose children, all of them, a combination holds."""
        if len(set(combination)) != len(combination) or any(s not in self.mapping for s in combination):
            return None
        parents = {self.mapping[s] for s in combination}
        whole = {s for s, p in self.mapping.items() if p in parents}
        return parents if whole == set(combination) else None

    def combination_is_valid(self, combination, context):
        parents = self._parents_of(combination)
        return parents is not None and len(parents) == self.parent_k


class GroupQuotaHierarchicalCombiGen(ExhaustiveHierarchicalCombiGen):
    """All children of parent sets with a fixed number of parents from each group."""

    def __init__(self, parent_k: int, slice_to_parent_mapping: dict[str, str], parent_to_group_mapping: dict[str, str], group_quota: dict[str, int]):
        super().__init__(parent_k, slice_to_parent_mapping)
        if sum(group_quota.values()) != parent_k:
            raise ValueError("group quotas must sum to parent_k")
        missing = set(slice_to_parent_mapping.values()) - set(parent_to_group_mapping)
        if missing:
            raise ValueError(f"parents without a group: {sorted(missing)}")
        unknown = set(parent_to_group_mapping[p] for p in set(slice_to_parent_mapping.values())) - set(group_quota)
        if unknown:
            raise ValueError(f"groups without a quota: {sorted(unknown)}")
        self.groups, self.quota = parent_to_group_mapping, group_quota

    @classmethod
    def from_slicers(cls, parent_k, df, child_slicer, parent_slicer, parent_to_group_mapping, group_quota, ts_col="ts"):
        return cls(parent_k, parents_of(df, child_slicer, parent_slicer, ts_col), parent_to_group_mapping, group_quota)

    @classmethod
    def from_slicers_with_seasons(cls, parent_k: int, df: DataFrame, child_slicer: TimeSlicer, group_quota: dict[str, int], ts_col: str = "ts"):
        """Parents are months, groups their seasons."""
        mapping = parents_of(df, child_slicer, TimeSlicer("month"), ts_col)
        return cls(parent_k, mapping, {p: SEASONS[int(p[5:7]) % 12 // 3] for p in mapping.values()}, group_quota)

    def _sets(self, spark):
        return _quota_sets(spark, [(self.groups[p], p) for p in self._parents()], "string", self.quota)

    def count(self, context):
        held = [self.groups[p] for p in self._parents()]
        return math.prod(math.comb(held.count(g), q) for g, q in self.quota.items())

    def combination_is_valid(self, combination, context):
        parents = self._parents_of(combination)
        if parents is None or len(parents) != self.parent_k:
            return False
        held = [self.groups[p] for p in parents]
        return all(held.count(g) == q for g, q in self.quota.items())


def parents_of(df: DataFrame, child: TimeSlicer, parent: TimeSlicer, ts_col: str = "ts") -> dict[str, str]:
    """Label of the parent period of each child period; a child of two parents goes to the later one."""
    ts = F.col(ts_col)
    label = lambda s: s.slice_label(s.slice_start(ts))
    found = df.groupBy(label(child).alias("child")).agg(F.max_by(label(parent), ts).alias("parent"))
    return {r["child"]: r["parent"] for r in found.collect()}
