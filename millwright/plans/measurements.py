"""Questions about the long measurement table.

Two small tables are kept beside it. ``feature_totals`` has its rows per station and feature.
``measured_parts`` has the distinct parts of every station as bitmaps, one per station and run of
32,768 part ids: exact distinct counts of any set of stations, or of several loads, are then unions of
bitmaps, and no part id is ever shuffled for them again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import TARGET_STATION

# Bitmaps pay if a station's bitmap over all ids is at most this many bytes for each part.
BYTES_PER_PART = 16


def station_measurement_coverage(measurements: DataFrame, station: str = TARGET_STATION) -> DataFrame:
    """Measurements, distinct features and distinct parts of one station; no row if it has none.

    The station equality prunes the station partitions of a published measurement table.
    """
    return (
        measurements.where(F.col("station") == station)
        .groupBy("station")
        .agg(
            F.count(F.lit(1)).alias("measurements"),
            F.countDistinct("feature_name").alias("features"),
            F.countDistinct("part_id").alias("parts"),
        )
    )


def feature_totals(measurements: DataFrame) -> DataFrame:
    """Rows of every station and feature, and how many have no matched time."""
    return measurements.groupBy("station", "feature_name").agg(
        F.count(F.lit(1)).alias("measurements"), F.count_if(F.col("observed_time").isNull()).alias("missing_times")
    )


def close_ids(parts: DataFrame) -> bool:
    """Whether bitmaps over the ids of ``parts`` stay small: at most ``BYTES_PER_PART`` a part and station."""
    low, high, count = parts.agg(F.min("part_id"), F.max("part_id"), F.count("part_id")).first()
    return bool(count) and (high - low + 1) // 8 <= BYTES_PER_PART * count + (1 << 20)


def measured_parts(measurements: DataFrame) -> DataFrame:
    """``station, bucket, parts``: the distinct parts of every station, a bitmap for each run of ids.

    Bitmaps are built before the shuffle, which moves one per task, station and run of ids.
    """
    return measurements.groupBy("station", F.expr("bitmap_bucket_number(part_id)").alias("bucket")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(part_id))").alias("parts")
    )


def measurement_coverage(totals: DataFrame, parts: DataFrame, group: Column | None = None) -> DataFrame:
    """Measurements, distinct features and distinct parts by ``group``, from the two kept tables.

    ``group`` is made of ``station``, which is the default; it may join stations, such as their line.
    Both tables may also be unions over several loads: counts add up, bitmaps are united.
    """
    name = "station" if group is None else "station_group"
    key = (F.col("station") if group is None else group).alias(name)
    counts = totals.groupBy(key, "feature_name").agg(F.sum("measurements").alias("n")).groupBy(name).agg(
        F.sum("n").alias("measurements"), F.count("feature_name").alias("features")
    )
    united = parts.groupBy(key, "bucket").agg(F.expr("bitmap_or_agg(parts)").alias("united"))
    sizes = united.groupBy(name).agg(F.sum(F.expr("bitmap_count(united)")).alias("parts"))
    return counts.join(sizes, name)


def kept_station_coverage(totals: DataFrame, parts: DataFrame, station: str = TARGET_STATION) -> DataFrame:
    """:func:`station_measurement_coverage` from the kept tables."""
    one = F.col("station") == station
    return measurement_coverage(totals.where(one), parts.where(one))


def measurement_validation(measurements: DataFrame) -> DataFrame:
    """Measurements, distinct features and measurements without a matched time.

    Counted per feature first, so one scan with a tiny shuffle answers all three.
    """
    per_feature = measurements.groupBy("feature_name").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("observed_time").isNull()).alias("untimed")
    )
    return per_feature.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("measurements"),
        F.count("feature_name").alias("features"),
        F.coalesce(F.sum("untimed"), F.lit(0)).alias("missing_times"),
    )
