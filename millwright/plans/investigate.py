"""Comparisons of the parts seen at one suspect station with the other parts of its line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import COHORTS, LINES, TARGET_LINE, TARGET_STATION
from ..functions.naming import has_line
from ..operators.routes import line_visits, part_routes, require_routes
from ..operators.summary import failure_summary
from ..operators.tiles import global_ntile


def _target_label(labels: Sequence[str]) -> Column:
    seen, not_seen = labels
    return F.when(F.col("visited_target"), F.lit(seen)).otherwise(F.lit(not_seen))


def _outcomes(parts: DataFrame) -> DataFrame:
    return parts.select("part_id", "response")


def _line_routes(
    visits: DataFrame | None, line: str, station: str, lines: Sequence[str], routes: DataFrame | None
) -> DataFrame:
    """Routes of the parts seen on the line, from stored routes or from the visits of that line."""
    if routes is None:
        routes, lines = part_routes(line_visits(visits, line, station), (line,), line, station), (line,)
    require_routes(routes, lines, line, station)
    return routes.where(has_line(F.col("line_mask"), list(lines).index(line), lines))


def target_vs_line(
    parts: DataFrame,
    visits: DataFrame | None,
    line: str = TARGET_LINE,
    station: str = TARGET_STATION,
    lines: Sequence[str] = LINES,
    labels: Sequence[str] | None = None,
    by_rate: bool = False,
    routes: DataFrame | None = None,
) -> DataFrame:
    """Parts of the line seen at the station against the other parts of the line.

    Sorted by label, or with ``by_rate`` by failure percentage, highest first. ``routes`` may be a
    stored :func:`part_routes` result over ``lines`` for this line and station; others raise.
    """
    labels = labels or (f"{station} observed", f"Other {line} parts")
    on_line = _line_routes(visits, line, station, lines, routes).select("part_id", "visited_target")
    return (
        failure_summary(on_line.join(_outcomes(parts), "part_id"), "visited_target")
        .select(_target_label(labels).alias("part_group"), "parts", "failed_parts", "failure_pct")
        .orderBy(*([F.col("failure_pct").desc()] if by_rate else []), "part_group")
    )


def target_within_line_group(
    parts: DataFrame,
    visits: DataFrame | None,
    line: str = TARGET_LINE,
    station: str = TARGET_STATION,
    lines: Sequence[str] = LINES,
    labels: Sequence[str] | None = None,
    routes: DataFrame | None = None,
) -> DataFrame:
    """The same comparison inside each combination of lines that includes ``line``."""
    labels = labels or (f"{station} observed", f"{station} not observed")
    routes = part_routes(visits, lines, line, station) if routes is None else routes
    require_routes(routes, lines, line, station)
    mask = F.col("line_mask")
    on_line = routes.where(has_line(mask, list(lines).index(line), lines))
    words = [F.when(has_line(mask, i, lines), F.lit(name)) for i, name in enumerate(lines) if name != line]
    joined = on_line.select("part_id", "line_mask", "visited_target").join(_outcomes(parts), "part_id")
    return (
        failure_summary(joined, "line_mask", "visited_target")
        .withColumn("line_group", F.concat_ws(" ", *words, F.lit(line)))
        .orderBy("line_group", F.col("visited_target").desc())
        .select("line_group", _target_label(labels).alias("s32_group"), "parts", "failed_parts", "failure_pct")
    )


def line_entry_times(
    visits: DataFrame | None,
    line: str = TARGET_LINE,
    station: str = TARGET_STATION,
    lines: Sequence[str] = LINES,
    routes: DataFrame | None = None,
) -> DataFrame:
    """Parts of the line that have a first time on it: ``part_id, visited_target, first_line_time``."""
    return (
        _line_routes(visits, line, station, lines, routes)
        .where(F.col("first_line_time").isNotNull())
        .select("part_id", "visited_target", "first_line_time")
    )


def time_cohorts(
    visits: DataFrame | None,
    line: str = TARGET_LINE,
    station: str = TARGET_STATION,
    tiles: int = COHORTS,
    lines: Sequence[str] = LINES,
    routes: DataFrame | None = None,
) -> DataFrame:
    """Equal-sized cohorts of the line's parts by first time on the line (ties by part)."""
    timed = line_entry_times(visits, line, station, lines, routes)
    return global_ntile(timed, tiles, ["first_line_time", "part_id"], "time_cohort")


def target_within_cohort(
    parts: DataFrame,
    visits: DataFrame | None,
    line: str = TARGET_LINE,
    station: str = TARGET_STATION,
    tiles: int = COHORTS,
    lines: Sequence[str] = LINES,
    labels: Sequence[str] | None = None,
    routes: DataFrame | None = None,
) -> DataFrame:
    """The comparison inside each time cohort.

    Outcomes are attached before the rows are ordered, while they are still partitioned by part,
    so nothing is joined back afterwards. Parts without an outcome still take their place in the
    order and are left out of the counts.
    """
    labels = labels or ("S32 observed", "S32 not observed")
    timed = line_entry_times(visits, line, station, lines, routes).join(
        _outcomes(parts).withColumn("known", F.lit(True)), "part_id", "left"
    )
    cohorts = global_ntile(timed, tiles, ["first_line_time", "part_id"], "time_cohort")
    return (
        failure_summary(cohorts.where("known"), "time_cohort", "visited_target")
        .orderBy("time_cohort", F.col("visited_target").desc())
        .select("time_cohort", _target_label(labels).alias("s32_group"), "parts", "failed_parts", "failure_pct")
    )
