"""Sources and sinks: CSV/Parquet tables in, CSV/Parquet out."""

from .tables import insight_table, normalise, read_table, write_csv, write_insights

__all__ = ["read_table", "write_csv", "insight_table", "write_insights", "normalise"]
