"""Profiles of the raw sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import ID, LABEL
from ..functions.rates import rate
from ..operators.catalog import CATALOG_SCHEMA
from ..operators.gates import id_balance, one_to_one
from ..operators.reshape import filled_cells, stations_seen, time_columns
from ..sources.wide import feature_columns


def id_profile(df: DataFrame, key: str = ID) -> DataFrame:
    """Rows, unique ids, repeated ids (rows beyond the first of each id) and rows without an id."""
    per_id = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    known = F.col(key).isNotNull()
    return per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count_if(known).alias("unique_ids"),
        F.coalesce(F.sum(F.when(known, F.col("n") - 1)), F.lit(0)).alias("duplicate_ids"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("missing_ids"),
    )


def label_counts(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Rows per label, a missing label included."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))


def id_set_difference(left: DataFrame, right: DataFrame, key: str = ID) -> DataFrame:
    """How many distinct ids each source has that the other has not."""
    known = F.col(key).isNotNull()
    return id_balance(left, right, key).agg(
        F.count_if(known & (F.col("right_rows") == 0)).alias("only_left"),
        F.count_if(known & (F.col("left_rows") == 0)).alias("only_right"),
    )


def column_coverage(df: DataFrame) -> DataFrame:
    """Share of rows with a value, per feature column; empty columns are kept.

    Each row is folded into one array whose filled cells are counted by position: one scan, and a
    partial aggregate with at most one entry per column. (One `count` per column in a single
    aggregate is several times slower at a thousand columns.) A cell filled in every row counts
    the rows on the way.
    """
    slots = [(-1, None), *enumerate(feature_columns(df))]
    columns = df.sparkSession.createDataFrame(slots, "position INT, column_name STRING")
    counted = filled_cells(df).groupBy("position").agg(F.count(F.lit(1)).alias("n"))
    observed = F.coalesce("n", F.lit(0).cast("long"))
    # One row per column from here on.
    row_count = F.max(F.when(F.col("position") == -1, observed)).over(Window.partitionBy())
    return (
        columns.join(counted, "position", "left")
        .select("position", "column_name", observed.alias("observed"), row_count.alias("rows"))
        .where(F.col("position") >= 0)
        .withColumn("coverage", rate(F.col("observed"), F.col("rows")))
    )


def coverage_distribution(coverage: DataFrame, sparse_below: float = 0.10) -> DataFrame:
    """Spread of the column coverages: minimum, median, maximum, empty and nearly empty columns."""
    return coverage.agg(
        F.count(F.lit(1)).alias("columns"),
        F.min("coverage").alias("min_coverage"),
        F.median("coverage").alias("median_coverage"),
        F.max("coverage").alias("max_coverage"),
        F.count_if(F.col("coverage") == 0).alias("empty_columns"),
        F.count_if(F.col("coverage") < sparse_below).alias("sparse_columns"),
    )


def station_profile(dates: DataFrame, labels: DataFrame) -> DataFrame:
    """Parts seen and failed per station of the raw date source; unvisited stations are kept.

    Each part crosses the join as its id and one true/false array; the array is unfolded
    afterwards, on the way into a partial aggregate.
    """
    stations = list(time_columns(dates))
    names = dates.sparkSession.createDataFrame(list(enumerate(stations)), CATALOG_SCHEMA).select(
        F.col("position").alias("station_number"), F.col("column_name").alias("station")
    )
    merged = one_to_one(stations_seen(dates), labels.select(ID, LABEL))
    counts = (
        merged.select(LABEL, F.posexplode_outer("seen").alias("station_number", "seen"))
        .where("seen")
        .groupBy("station_number")
        .agg(F.count(F.lit(1)).alias("parts_visited"), F.sum(LABEL).alias("failed_parts"))
    )
    zero = F.lit(0).cast("long")
    return (
        names.join(counts, "station_number", "left")
        .select(
            "station",
            F.coalesce("parts_visited", zero).alias("parts_visited"),
            F.coalesce("failed_parts", zero).alias("failed_parts"),
        )
        .withColumn("failure_rate", rate(F.col("failed_parts"), F.col("parts_visited")))
        .orderBy(F.col("parts_visited").desc(), "station")
    )


def most_visited(profile: DataFrame, k: int = 10) -> DataFrame:
    return profile.orderBy(F.col("parts_visited").desc(), "station").limit(k)


def least_visited(profile: DataFrame, k: int = 10) -> DataFrame:
    return profile.orderBy(F.col("parts_visited").asc(), F.col("station").desc()).limit(k)
