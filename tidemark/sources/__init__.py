"""Time series as DataFrames."""

from tidemark.sources.series import daily_shipments, hourly_events, read_csv_series

__all__ = ["daily_shipments", "hourly_events", "read_csv_series"]
