"""Rates. Ratios are doubles throughout; decimal literals would truncate them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..contracts import ENOUGH_DATA, LITTLE_DATA, MIN_FAILED, MIN_PARTS


def outcome_counts(parts: str = "parts", failed: str = "failed_parts", response: str = "response") -> list[Column]:
    """The two aggregates behind every failure report."""
    return [F.count(F.lit(1)).alias(parts), F.sum(response).cast("long").alias(failed)]


def rate(failed: Column, total: Column) -> Column:
    """Share of failures; NULL when nothing was counted."""
    return failed.cast("double") / F.nullif(total.cast("double"), F.lit(0.0))


def percent(failed: Column, total: Column, digits: int = 3) -> Column:
    return F.round(F.lit(100.0) * failed / F.nullif(total.cast("double"), F.lit(0.0)), digits)


def relative_rate(own: Column, overall: Column) -> Column:
    """Own rate as a multiple of the overall one; NULL when the overall rate is 0."""
    return own / F.nullif(overall, F.lit(0.0))


def review_status(total: Column, failed: Column, min_parts: int = MIN_PARTS, min_failed: int = MIN_FAILED) -> Column:
    enough = (total >= min_parts) & (failed >= min_failed)
    return F.when(enough, F.lit(ENOUGH_DATA)).otherwise(F.lit(LITTLE_DATA))
