"""The failure report shared by all outcome analyses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rates import outcome_counts, percent


def failure_summary(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Parts, failed parts and failure percentage per key."""
    return df.groupBy(*keys).agg(*outcome_counts()).withColumn(
        "failure_pct", percent(F.col("failed_parts"), F.col("parts"))
    )
