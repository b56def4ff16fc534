"""Wide time series: a timestamp column and one double column per variable.

Any DataFrame of that shape can be analysed; these readers build the usual ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def read_csv_series(spark: SparkSession, path: str, ts_col: str = "ts", value_cols: list[str] | None = None) -> DataFrame:
    """A CSV file with a header whose first column, or ts_col if present, is the time; other columns become doubles."""
    raw = spark.read.csv(path, header=True)
    time = ts_col if ts_col in raw.columns else raw.columns[0]
    values = value_cols or [c for c in raw.columns if c != time]
    return raw.select(F.col(time).cast("timestamp_ntz").alias(ts_col), *[F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in values])


def hourly_events(spark: SparkSession, sf_dir: str, first: str | None = None, days: int | None = None) -> DataFrame:
    """Sum of event values by hour and type, 0 where there is none, over a gap-free range of whole days.

    The range is that of the events where first and days do not say otherwise.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type", "value")
    if first is None or days is None:
        day = F.date_trunc("day", F.col("ts")).cast("date")
        low, span = events.agg(F.min(day).cast("string"), F.datediff(F.max(day), F.min(day)) + 1).first()
        first, days = first or low or "1970-01-01", days if days is not None else span or 0
    hour = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz")
    sums = events.groupBy(hour.alias("ts")).pivot("event_type", list(EVENT_TYPES)).agg(F.sum("value"))
    spine = spark.range(24 * days).select(F.expr(f"TIMESTAMP_NTZ '{first} 00:00:00' + make_dt_interval(0, cast(id AS int))").alias("ts"))
    return spine.join(sums, "ts", "left").select("ts", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in EVENT_TYPES])


def daily_shipments(spark: SparkSession, sf_dir: str, year: int | None = None) -> DataFrame:
    """Quantity and price shipped and the mean discount by day, of all years or one; days without shipments are absent."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    if year is not None:
        first, after = (F.lit(f"{y}-01-01").cast("timestamp_ntz") for y in (year, year + 1))
        items = items.where((F.col("l_shipdate") >= first) & (F.col("l_shipdate") < after))
    day = F.date_trunc("day", F.col("l_shipdate")).cast("timestamp_ntz")
    return items.groupBy(day.alias("ts")).agg(F.sum("l_quantity").alias("qty"), F.sum("l_extendedprice").alias("price"), F.avg("l_discount").alias("disc"))
