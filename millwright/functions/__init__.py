"""Column functions: naming rules and rates."""

from .naming import has_bit, line_bits, mapped_date_name, on_line, route_label, station_of
from .rates import outcome_counts, percent, rate, relative_rate, review_status

__all__ = [
    "has_bit",
    "line_bits",
    "mapped_date_name",
    "on_line",
    "outcome_counts",
    "percent",
    "rate",
    "relative_rate",
    "review_status",
    "route_label",
    "station_of",
]
