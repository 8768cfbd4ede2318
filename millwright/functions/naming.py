"""Rules that read meaning out of column and station names."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..contracts import NO_VISITS

# Fixed value: a measurement column is <station>_F<number>.
FEATURE_PATTERN = r"^(L\d+_S\d+)_F(\d+)$"

MASK_BITS = 62  # lines in one word of a line mask: a signed 64-bit number less the target's flag


def station_of(name: Column) -> Column:
    """Station of a time column: its first two name pieces, whatever they are."""
    return F.substring_index(name, "_", 2)


def mapped_date_name(feature: Column) -> Column:
    """Name of the time column a measurement column is paired with; NULL for other names.

    The number is read as an integer, so ``F007`` is paired with ``D8``.
    """
    station = F.regexp_extract(feature, FEATURE_PATTERN, 1)
    number = F.regexp_extract(feature, FEATURE_PATTERN, 2)
    return F.when(
        station != "",
        F.concat(station, F.lit("_D"), (number.try_cast("decimal(38,0)") + 1).cast("string")),
    )


def on_line(station: Column, line: str) -> Column:
    """``station LIKE '<line>_S%'``, where ``_`` stands for any one character.

    Written as a prefix plus one character so that the prefix reaches the Parquet
    scan and no regular expression runs per row.
    """
    return station.startswith(line) & (F.substring(station, len(line) + 2, 1) == "S")


def line_bits(station: Column, lines: Sequence[str]) -> Column:
    """One bit per line, in line order: the lines a station name belongs to."""
    bits = [F.when(on_line(station, line), F.lit(1 << i)).otherwise(F.lit(0)) for i, line in enumerate(lines)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits, F.lit(0)).cast("long")


def has_bit(mask: Column, position: int) -> Column:
    return mask.bitwiseAND(F.lit(1 << position).cast("long")) != 0


def has_line(mask: Column, position: int, lines: Sequence[str]) -> Column:
    """Whether a line mask over ``lines`` has the line at ``position``.

    Up to ``MASK_BITS`` lines are one number, more are an array of such numbers.
    """
    word, bit = divmod(position, MASK_BITS)
    return has_bit(mask if len(lines) <= MASK_BITS else F.get(mask, F.lit(word)), bit)


def no_lines(lines: Sequence[str]) -> Column:
    """The line mask of a part that was seen on none of ``lines``."""
    zero = F.lit(0).cast("long")
    return zero if len(lines) <= MASK_BITS else F.array_repeat(zero, -(-len(lines) // MASK_BITS))


def route_label(mask: Column, lines: Sequence[str], empty: str | None = NO_VISITS, suffix: str | None = None) -> Column:
    """Text like ``L0 L2`` for a line mask, in line order, with an optional fixed last word."""
    words = [F.when(has_line(mask, i, lines), F.lit(line)) for i, line in enumerate(lines)]
    if suffix is not None:
        words.append(F.lit(suffix))
    label = F.concat_ws(" ", *words) if words else F.lit("")
    if empty is None or suffix is not None:
        return label
    return F.when(mask == no_lines(lines), F.lit(empty)).otherwise(label)
