"""What the visits say about one part: the lines it touched, the target station, the first time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contracts import LINES, TARGET_LINE, TARGET_STATION
from ..functions.naming import MASK_BITS, has_bit, has_line, line_bits, on_line


def part_routes(
    visits: DataFrame,
    lines: Sequence[str] = LINES,
    line: str = TARGET_LINE,
    station: str = TARGET_STATION,
) -> DataFrame:
    """One row per visited part: ``line_mask, visited_target, first_line_time``.

    All line flags and the target flag share one bit mask, so each part crosses the shuffle as a
    key, a mask and a time. The mask is combined before the shuffle, which also shrinks a part
    that repeats very often to one row per input partition. Duplicate visits cannot change it.
    Beyond ``MASK_BITS`` lines there are several masks, and ``line_mask`` is their array. The
    column carries the parameters along, also through Parquet; see :func:`require_routes`.
    """
    words = [lines[i : i + MASK_BITS] for i in range(0, len(lines), MASK_BITS)] or [()]
    seen = [line_bits(F.col("station"), word) for word in words]
    seen[0] = seen[0].bitwiseOR(
        F.when(F.col("station") == station, F.lit(1 << MASK_BITS)).otherwise(F.lit(0)).cast("long")
    )
    line_time = F.when(on_line(F.col("station"), line), F.col("first_observed_time"))
    masks = [F.col(f"mask_{i}") for i in range(len(words))]
    masks[0] = masks[0].bitwiseAND(F.lit((1 << MASK_BITS) - 1).cast("long"))
    return (
        visits.groupBy("part_id")
        .agg(*[F.bit_or(s).alias(f"mask_{i}") for i, s in enumerate(seen)], F.min(line_time).alias("first_line_time"))
        .select(
            "part_id",
            (masks[0] if len(masks) == 1 else F.array(*masks)).alias(
                "line_mask", metadata={"lines": list(lines), "line": line, "station": station}
            ),
            has_bit(F.col("mask_0"), MASK_BITS).alias("visited_target"),
            "first_line_time",
        )
    )


def require_routes(
    routes: DataFrame, lines: Sequence[str], line: str | None = None, station: str | None = None
) -> DataFrame:
    """``routes`` if they were made with these parameters; a line or station of None is not compared."""
    made = routes.schema["line_mask"].metadata
    wanted = {"lines": list(lines)}
    wanted |= {name: value for name, value in (("line", line), ("station", station)) if value is not None}
    if any(made.get(name) != value for name, value in wanted.items()):
        raise ValueError(f"these routes were made with {made or 'unknown parameters'}, not with {wanted}")
    return routes


def line_visits(visits: DataFrame, line: str = TARGET_LINE, station: str = TARGET_STATION) -> DataFrame:
    """A superset of the visits that matter for one line and one station.

    Only name prefixes are compared, which the scan can push down. Names that share
    the prefix without being on the line get no line bit in :func:`part_routes`.
    """
    wanted = F.col("station").startswith(line)
    if not station.startswith(line):
        wanted = wanted | (F.col("station") == station)
    return visits.where(wanted)


def route_flags(routes: DataFrame, lines: Sequence[str] = LINES) -> DataFrame:
    """The mask spelled out as one 0/1 column per line, plus the target flag."""
    flags = [has_line(F.col("line_mask"), i, lines).cast("int").alias(line.lower()) for i, line in enumerate(lines)]
    require_routes(routes, lines)
    return routes.select("part_id", *flags, F.col("visited_target").cast("int").alias("visited_target"), "first_line_time")
