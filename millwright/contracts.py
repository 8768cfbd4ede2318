"""Table contracts, defaults and fixed values shared by the whole package."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

ID = "Id"
LABEL = "Response"

PARTS_SCHEMA = T.StructType(
    [
        T.StructField("part_id", T.LongType(), False),
        T.StructField("response", T.ByteType(), False),
    ]
)

VISITS_SCHEMA = T.StructType(
    [
        T.StructField("part_id", T.LongType(), False),
        T.StructField("station", T.StringType(), False),
        T.StructField("first_observed_time", T.DoubleType()),
        T.StructField("last_observed_time", T.DoubleType()),
    ]
)

STATION_SETS_SCHEMA = T.StructType(
    [
        T.StructField("part_id", T.LongType(), False),
        T.StructField("stations", T.ArrayType(T.LongType()), False),
    ]
)

# Serves both the mapped measurements and the older pilot `measurements` table.
MEASUREMENTS_SCHEMA = T.StructType(
    [
        T.StructField("part_id", T.LongType(), False),
        T.StructField("station", T.StringType(), False),
        T.StructField("feature_name", T.StringType(), False),
        T.StructField("measurement_value", T.DoubleType(), False),
        T.StructField("date_feature_name", T.StringType()),
        T.StructField("observed_time", T.DoubleType()),
    ]
)

# Kept beside the measurements: totals per feature, and the measured parts of a station as bitmaps.
FEATURE_TOTALS_SCHEMA = T.StructType(
    [
        T.StructField("station", T.StringType(), False),
        T.StructField("feature_name", T.StringType(), False),
        T.StructField("measurements", T.LongType(), False),
        T.StructField("missing_times", T.LongType(), False),
    ]
)

MEASURED_PARTS_SCHEMA = T.StructType(
    [
        T.StructField("station", T.StringType(), False),
        T.StructField("bucket", T.LongType(), False),
        T.StructField("parts", T.BinaryType(), False),
    ]
)

# Keys per table: Spark has no primary keys, so the gates in `operators.gates` check these.
TABLE_KEYS = {
    "parts": ["part_id"],
    "station_visits": ["part_id", "station"],
    "mapped_measurements": ["part_id", "feature_name"],
    "measurements": ["part_id", "feature_name"],
}

# Order of visits inside a bucket of parts: names of one line lie together.
VISIT_ORDER = ["station", "part_id"]

# Defaults of the analyses; every one of them is a parameter.
LINES = ("L0", "L1", "L2", "L3")
TARGET_LINE = "L3"
TARGET_STATION = "L3_S32"
MIN_PARTS = 1000
MIN_FAILED = 20
TOP_STATIONS = 15
COHORTS = 10

# Fixed label texts.
NO_VISITS = "No recorded visits"
ENOUGH_DATA = "sufficient_for_initial_review"
LITTLE_DATA = "limited_sample"


@dataclass(frozen=True)
class Expected:
    """Counts that a complete load must reach (fixed values of the training set)."""

    parts: int = 1_183_747
    failed_parts: int = 6_879
    stations: int = 52
    mapped_features: int = 366
    missing_times: int = 0
    numeric_columns: int = 970
    date_columns: int = 1_157


class GateError(ValueError):
    """A data-quality gate did not hold; nothing has been published."""
