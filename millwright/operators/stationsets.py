"""One set of stations per part: bits of a few numbers, in the order of the stations' columns.

A load writes the sets from the same scan of the dates as the visits. Routes, station counts and parts
without visits are all read from them, one short row per part instead of a dozen visits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import LINES, TARGET_LINE, TARGET_STATION
from ..functions.naming import MASK_BITS
from ..functions.rates import rate


def set_words(conditions: Sequence[str]) -> str:
    """SQL for the set of all conditions that hold, numbered in their order."""
    words = []
    for at in range(0, len(conditions), MASK_BITS):
        bits = [f"IF({c}, {1 << i}L, 0L)" for i, c in enumerate(conditions[at : at + MASK_BITS])]
        words.append(" | ".join(bits))
    return f"array({', '.join(words)})" if words else "CAST(array() AS array<bigint>)"


def named(sets: DataFrame, stations: Sequence[str]) -> DataFrame:
    """``sets`` with the names of its bits, which the column carries along."""
    return sets.withMetadata("stations", {"stations": list(stations)})


def names_of(sets: DataFrame) -> list[str]:
    names = sets.schema["stations"].metadata.get("stations")
    if names is None:
        raise ValueError("these sets do not say which stations their bits stand for")
    return names


def _has(number: int) -> Column:
    word, bit = divmod(number, MASK_BITS)
    return F.call_function("getbit", F.get("stations", F.lit(word)), F.lit(bit)) == 1


def _any_of(numbers: Sequence[int]) -> Column:
    """Whether the set has any of these stations: one comparison per word."""
    wanted: dict[int, int] = {}
    for number in numbers:
        word, bit = divmod(number, MASK_BITS)
        wanted[word] = wanted.get(word, 0) | 1 << bit
    found = F.lit(False)
    for word, bits in wanted.items():
        found = found | (F.get("stations", F.lit(word)).bitwiseAND(F.lit(bits).cast("long")) != 0)
    return found


def _empty() -> Column:
    return F.forall("stations", lambda word: word == 0)


def visited(sets: DataFrame) -> DataFrame:
    """Sets that hold any station."""
    return sets.where(~_empty())


def parts_without_stations(parts: DataFrame, sets: DataFrame) -> DataFrame:
    """Parts that were seen at no station.

    The merge hint rules out a broadcast: millions of ids are a small file and a large table in every task.
    """
    return parts.join(visited(sets).select("part_id").hint("merge"), "part_id", "left_anti")


def set_routes(
    sets: DataFrame, lines: Sequence[str] = LINES, line: str = TARGET_LINE, station: str = TARGET_STATION
) -> DataFrame:
    """``part_id, line_mask, visited_target`` of every visited part, like `part_routes` without its time.

    A narrow projection: nothing is grouped or moved.
    """
    names = names_of(sets)
    on = {ln: [i for i, name in enumerate(names) if name.startswith(ln) and name[len(ln) + 1 : len(ln) + 2] == "S"] for ln in lines}
    masks = []
    for at in range(0, max(len(lines), 1), MASK_BITS):
        mask = F.lit(0).cast("long")
        for i, ln in enumerate(lines[at : at + MASK_BITS]):
            mask = mask.bitwiseOR(F.when(_any_of(on[ln]), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
        masks.append(mask)
    mask = masks[0] if len(masks) == 1 else F.array(*masks)
    return visited(sets).select(
        "part_id",
        mask.alias("line_mask", metadata={"lines": list(lines), "line": line, "station": station}),
        _any_of([i for i, name in enumerate(names) if name == station]).alias("visited_target"),
    )


def station_counts(parts: DataFrame, sets: DataFrame) -> DataFrame:
    """``station, parts_visited, failed_parts`` of every station, also of one that no part was seen at.

    All counters stand in one row, so that a single aggregate without a key answers every station.
    """
    names = names_of(sets)
    if not names:
        return sets.sparkSession.createDataFrame([], "station string, parts_visited bigint, failed_parts bigint")
    counters = [
        F.struct(
            F.lit(name).alias("station"),
            F.count_if(_has(i)).alias("parts_visited"),
            F.count_if(_has(i) & (F.col("response") == 1)).alias("failed_parts"),
        )
        for i, name in enumerate(names)
    ]
    joined = sets.join(parts.select("part_id", "response"), "part_id")
    return joined.agg(F.array(*counters).alias("counters")).select(F.inline("counters"))


def set_profile(parts: DataFrame, sets: DataFrame) -> DataFrame:
    """Parts seen and failed per station, most visited first; unvisited stations are kept."""
    counts = station_counts(parts, sets)
    return counts.withColumn("failure_rate", rate(F.col("failed_parts"), F.col("parts_visited"))).orderBy(
        F.col("parts_visited").desc(), "station"
    )
