"""Sources: the wide CSV / Parquet files and the long tables built from them."""

from .tables import read_measurements, read_parts, read_table, read_visits
from .wide import feature_columns, first_parts, read_header, read_wide_csv, read_wide_parquet, wide_schema

__all__ = [
    "feature_columns",
    "first_parts",
    "read_header",
    "read_measurements",
    "read_parts",
    "read_table",
    "read_visits",
    "read_wide_csv",
    "read_wide_parquet",
    "wide_schema",
]
