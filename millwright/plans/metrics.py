"""Reusable quality metrics over ``parts`` and ``station_visits``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contracts import LINES, MIN_FAILED, MIN_PARTS, TOP_STATIONS
from ..functions.naming import no_lines, route_label
from ..functions.rates import outcome_counts, rate, relative_rate, review_status
from ..operators.routes import part_routes, require_routes
from ..operators.summary import failure_summary


def overall_quality(parts: DataFrame) -> DataFrame:
    """One row: parts processed, failed parts, failure rate."""
    return parts.agg(*outcome_counts("parts_processed")).withColumn(
        "failure_rate", rate(F.col("failed_parts"), F.col("parts_processed"))
    )


def station_exposure(
    parts: DataFrame, visits: DataFrame, min_parts: int = MIN_PARTS, min_failed: int = MIN_FAILED
) -> DataFrame:
    """Final failure rate of the parts observed at each station, next to the overall rate."""
    outcomes = parts.select("part_id", "response")
    counts = (
        visits.select("part_id", "station")
        .join(outcomes, "part_id")
        .groupBy("station")
        .agg(*outcome_counts("parts_observed"))
    )
    observed, failed = F.col("parts_observed"), F.col("failed_parts")
    # The overall rate is a scalar subquery: one value, no join.
    overall = overall_quality(parts).select("failure_rate").scalar()
    return (
        counts.withColumn("failure_rate", rate(failed, observed))
        .withColumn("overall_failure_rate", overall)
        .withColumn("rate_vs_overall", relative_rate(F.col("failure_rate"), F.col("overall_failure_rate")))
        .withColumn("review_status", review_status(observed, failed, min_parts, min_failed))
    )


def production_paths(
    parts: DataFrame, visits: DataFrame, lines: Sequence[str] = LINES, routes: DataFrame | None = None
) -> DataFrame:
    """Failure report per combination of lines a part was seen on.

    Visits are reduced to one mask per part before the outer join, and outcomes are summed per
    mask before any label text is made. Pass stored ``routes`` to skip the reduction.
    """
    routes = part_routes(visits, lines) if routes is None else routes
    require_routes(routes, lines)
    masked = parts.join(routes.select("part_id", "line_mask"), "part_id", "left").withColumn(
        "line_mask", F.coalesce("line_mask", no_lines(lines))
    )
    return failure_summary(masked, "line_mask").select(
        route_label(F.col("line_mask"), lines).alias("line_group"), "parts", "failed_parts", "failure_pct"
    )


def station_table(exposure: DataFrame, min_parts: int = MIN_PARTS) -> DataFrame:
    """Stations with enough parts, highest failure rate first (ties by name)."""
    return (
        exposure.where(F.col("parts_observed") >= min_parts)
        .select("station", "parts_observed", "failed_parts", "failure_rate")
        .orderBy(F.col("failure_rate").desc_nulls_last(), "station")
    )


def top_stations(
    parts: DataFrame, visits: DataFrame, min_parts: int = MIN_PARTS, k: int = TOP_STATIONS
) -> DataFrame:
    """The first ``k`` rows of :func:`station_table`."""
    return station_table(station_exposure(parts, visits), min_parts).limit(k)


def paths_by_volume(paths: DataFrame) -> DataFrame:
    """Production paths, most parts first (ties by name)."""
    return paths.orderBy(F.col("parts").desc(), "line_group")


def register_metric_views(parts: DataFrame, visits: DataFrame) -> None:
    """The three metric views under their usual names, for SQL users."""
    overall_quality(parts).createOrReplaceTempView("overall_quality_metrics")
    station_exposure(parts, visits).createOrReplaceTempView("station_exposure_metrics")
    production_paths(parts, visits).createOrReplaceTempView("production_path_metrics")
