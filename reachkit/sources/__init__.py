"""Sources: parquet/catalog scans, census CSV, the test-data impression views and
model rows given as literals."""

from reachkit.sources.schema import require_columns
from reachkit.sources.tables import (
    census_from_customers,
    event_impressions,
    line_impressions,
    read_census_csv,
    read_table,
)
from reachkit.sources.literals import mixture_table

__all__ = [
    "require_columns",
    "read_table",
    "read_census_csv",
    "event_impressions",
    "line_impressions",
    "census_from_customers",
    "mixture_table",
]
