"""Wide to long without a shuffle per cell.

Each wide row is folded into compact arrays by a single projection and then unfolded. The
expressions are written as SQL text: planning a thousand of them one Column call at a time takes
longer than running them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contracts import ID
from ..sources.wide import feature_columns
from .catalog import Pair, column_catalog, pairs_of
from .gates import one_to_one
from .stationsets import set_words


def _quoted(names: Sequence[str]) -> str:
    return ", ".join("`" + name.replace("`", "``") + "`" for name in names)


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def time_columns(dates: DataFrame) -> dict[str, list[str]]:
    """The columns of every station by the column catalog, stations in the order of their first column."""
    catalog = column_catalog(dates.sparkSession, dates.columns).where(F.col("station").isNotNull()).collect()
    stations = dict.fromkeys(row["station"] for row in catalog)
    return {station: [row["column_name"] for row in catalog if row["station"] == station] for station in stations}


def _seen(columns: Sequence[str]) -> str:
    return f"coalesce({_quoted(columns)}) IS NOT NULL"


def _extreme(function: str, columns: Sequence[str]) -> str:
    # `least` and `greatest` skip NULLs but want two arguments.
    return _quoted(columns) if len(columns) == 1 else f"{function}({_quoted(columns)})"


def visits_per_part(dates: DataFrame) -> DataFrame:
    """One row per part: the array of its observed stations with their time bounds, and their set."""
    grouped = time_columns(dates)
    entries = []
    for station, columns in grouped.items():
        entries.append(
            f"CASE WHEN {_seen(columns)} THEN struct({_text(station)} AS station, "
            f"{_extreme('least', columns)} AS first_observed_time, "
            f"{_extreme('greatest', columns)} AS last_observed_time) END"
        )
    return dates.selectExpr(
        f"{ID} AS part_id",
        f"array_compact(array({', '.join(entries)})) AS visits",
        f"{set_words([_seen(columns) for columns in grouped.values()])} AS stations",
    )


def unfold_visits(folded: DataFrame) -> DataFrame:
    # The outer form plus a filter keeps the optimizer from evaluating the array twice.
    return folded.selectExpr("part_id", "inline_outer(visits)").where(F.col("station").isNotNull())


def station_visits(dates: DataFrame) -> DataFrame:
    """Earliest and latest time per part and station; stations without any time give no row."""
    return unfold_visits(visits_per_part(dates))


def stations_seen(dates: DataFrame) -> DataFrame:
    """One row per part with a true/false array: was it seen at each station (in header order)."""
    seen = [_seen(columns) for columns in time_columns(dates).values()]
    return dates.selectExpr(ID, f"array({', '.join(seen)}) AS seen")


def filled_cells(df: DataFrame) -> DataFrame:
    """``position`` of every filled feature cell, in column order from 0, and -1 once per row."""
    folded = df.selectExpr(f"array(1D, {_quoted(feature_columns(df))}) AS cells")
    return (
        folded.selectExpr("posexplode_outer(cells) AS (slot, value)")
        .where(F.col("value").isNotNull())
        .select((F.col("slot") - 1).alias("position"))
    )


def _filled(columns: Sequence[str]) -> str:
    """SQL for the filled ones of ``columns``: their numbers ``i`` and their values ``x``, side by side."""
    numbers = [f"IF({_quoted([name])} IS NOT NULL, {i}, NULL)" for i, name in enumerate(columns)]
    return f"named_struct('i', array_compact(array({', '.join(numbers)})), 'x', array_compact(array({_quoted(columns)})))"


def pack_values(numeric: DataFrame, pairs: Sequence[Pair], *keep: str) -> DataFrame:
    """Mapped measurements that a part has, by pair number, next to the ``keep`` columns."""
    return numeric.selectExpr(f"{ID} AS part_id", *keep, f"{_filled([p.feature for p in pairs])} AS readings")


def pack_times(dates: DataFrame, pairs: Sequence[Pair]) -> DataFrame:
    """Matched times that a part has, by pair number."""
    return dates.selectExpr(f"{ID} AS part_id", f"{_filled([p.date for p in pairs])} AS times")


def _names(pairs: Sequence[Pair], field: str) -> str:
    """SQL for the name of pair number ``i``."""
    return f"get(array({', '.join(_text(getattr(p, field)) for p in pairs)}), i)"


def unfold_cells(
    values: DataFrame, times: DataFrame, pairs: Sequence[Pair], check_ids: bool = False
) -> DataFrame:
    """Join the two packed sides on the part and list every measurement that is present.

    ``part_id, station, i, measurement_value, observed_time``, where ``i`` is the pair number. Only
    filled cells cross the shuffle and are sorted: empty ones compress to nothing on the way, so that
    Spark, which sizes its tasks by the bytes moved, would give a task far more rows than fit its memory.
    A measurement whose matched time is missing is kept with a NULL time. The merge hint rules out a
    broadcast. With ``check_ids`` the result fails unless both sides hold the same parts exactly once.
    """
    values = values.select("part_id", "readings")
    if check_ids:
        joined = one_to_one(values, times, "part_id", aligned=True)
    else:
        joined = values.join(times.hint("merge"), "part_id")
    return (
        joined.selectExpr("part_id", "map_from_arrays(times.i, times.x) AS times", "readings")
        .selectExpr("part_id", "times", "inline_outer(arrays_zip(readings.i, readings.x)) AS (i, measurement_value)")
        .where(F.col("measurement_value").isNotNull())
        .selectExpr(
            "part_id",
            f"{_names(pairs, 'station')} AS station",
            "i",
            "measurement_value",
            "try_element_at(times, i) AS observed_time",
        )
    )


def number_stations(cells: DataFrame, pairs: Sequence[Pair]) -> DataFrame:
    """Unfolded cells with ``station_number`` for the name of the station, which :func:`name_cells` spells out again."""
    numbers = {station: n for n, station in enumerate(dict.fromkeys(p.station for p in pairs))}
    number = f"get(array({', '.join(str(numbers[p.station]) for p in pairs)}), i)"
    return cells.drop("station").selectExpr("*", f"{number} AS station_number")


def name_cells(cells: DataFrame, pairs: Sequence[Pair]) -> DataFrame:
    """Spell out the column names of unfolded cells; done last, so names never cross a shuffle."""
    return cells.selectExpr(
        "part_id",
        f"{_names(pairs, 'station')} AS station",
        f"{_names(pairs, 'feature')} AS feature_name",
        "measurement_value",
        f"{_names(pairs, 'date')} AS date_feature_name",
        "observed_time",
    )


def mapped_measurements(
    numeric: DataFrame, dates: DataFrame, pairs: Sequence[Pair] | None = None, check_ids: bool = False
) -> DataFrame:
    """Every present measurement with its matched time column and time, from two wide sources."""
    pairs = pairs_of(numeric, dates) if pairs is None else list(pairs)
    if not pairs:
        raise ValueError("no measurement column has a matching time column")
    cells = unfold_cells(pack_values(numeric, pairs), pack_times(dates, pairs), pairs, check_ids)
    return name_cells(cells, pairs)
