"""Places, running sums and quantiles in a global order without a window over everything.

Rows are sorted into ranges and summed within them; one row for each range says what the
ranges before it hold. So no task sees more than one range, and a quantile is the value of the
row whose running count covers the wanted rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.tables import stored

_RANGE_BITS = 33  # what monotonically_increasing_id leaves for the place within a range


def numbered_in_order(df: DataFrame, order: list, name: str, sums: dict[str, str] | None = None) -> DataFrame:
    """df with name, the place of each row from 0 in the given order, and the sums of columns over the rows before it.

    sums: column to name. Rows that tie in the order follow each other in any order, fixed once:
    the sorted rows are a stored table, so a lost executor changes no number.
    """
    sums = sums or {}
    placed = stored(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", _RANGE_BITS)), "ordered")
    before = Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    totals = placed.groupBy(F.col("_part").alias("_of")).agg(F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(f"_{n}") for c, n in sums.items()])
    totals = totals.select("_of", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("_rows", *[f"_{n}" for n in sums.values()])])
    within = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    columns = {name: (F.col("_rows_before") + F.col("_at").bitwiseAND(F.lit((1 << _RANGE_BITS) - 1))).cast("long")}
    columns |= {n: F.col(f"_{n}_before") + F.coalesce(F.sum(c).over(within), F.lit(0)) for c, n in sums.items()}
    found = placed.join(F.broadcast(totals), F.col("_part") == F.col("_of"))
    return found.withColumns(columns).select(*df.columns, *columns)


def value_grid(counts: DataFrame, group: str = "variable", value: str = "value", n: str = "n", few: bool = True) -> DataFrame:
    """group, value, n, at (place among the group's distinct values), before (rows with smaller values) and total, stored.

    counts: group, value and how many rows have it; rows of one value add up. few: there are so few
    groups, as variables or scores, that one row for each can be sent to all tasks.
    """
    values = counts.groupBy(group, value).agg(F.sum(n).alias("n"))
    placed = numbered_in_order(values, [group, value], "place", {"n": "sum"})
    first = placed.groupBy(group).agg(F.min("place").alias("place_0"), F.min("sum").alias("sum_0"), F.sum("n").alias("total"))
    first = first.withColumnRenamed(group, "_group")
    found = placed.join(F.broadcast(first) if few else first, F.col(group).eqNullSafe(F.col("_group")))
    return found.select(group, value, "n", (F.col("place") - F.col("place_0")).alias("at"), (F.col("sum") - F.col("sum_0")).alias("before"), "total").transform(stored, "grid")


def quantiles(grid: DataFrame, points: list[float], group: str = "variable", value: str = "value") -> DataFrame:
    """group and q, the array of exact quantiles at points, by linear interpolation between ranks.

    A point p of a group of n rows lies at rank p (n - 1). A row of the grid covers the ranks from
    before to before + n - 1; only rows that cover a wanted rank pass on, at most two for each
    point, whatever the number of distinct values. A group without rows is absent.
    """
    last = F.col("before") + F.col("n") - 1
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("total") - 1)).alias("rank")) for i, p in enumerate(points)])

    def covers(rank: Column) -> Column:
        return rank.between(F.col("before"), last)

    def share(w: Column) -> Column:
        """What the row's value weighs in the interpolation at a rank."""
        low, high, rank = F.floor(w["rank"]), F.ceil(w["rank"]), w["rank"]
        return F.when(low == high, 1.0).otherwise(F.when(covers(low), high - rank).otherwise(0.0) + F.when(covers(high), rank - low).otherwise(0.0))

    served = F.filter(wanted, lambda w: covers(F.floor(w["rank"])) | covers(F.ceil(w["rank"])))
    parts = grid.select(group, value, F.explode(F.transform(served, lambda w: F.struct(w["i"].alias("i"), share(w).alias("share")))).alias("part"))
    sums = parts.groupBy(group, F.col("part")["i"].alias("i")).agg(F.sum(F.col(value) * F.col("part")["share"]).alias("v"))
    return sums.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("q"))
