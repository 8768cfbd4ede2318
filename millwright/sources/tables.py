"""Scans of the long tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..contracts import MEASUREMENTS_SCHEMA, PARTS_SCHEMA, VISITS_SCHEMA


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, view: str | None = None) -> DataFrame:
    """Parquet scan with a known schema; ``view`` also names it for SQL."""
    if schema is None:
        df = spark.read.parquet(path)
    else:
        # Partition columns come last in a scan; the contract's order is restored.
        df = spark.read.schema(schema).parquet(path).select(*schema.fieldNames())
    if view:
        df.createOrReplaceTempView(view)
    return df


def read_parts(spark: SparkSession, path: str, view: str | None = None) -> DataFrame:
    return read_table(spark, path, PARTS_SCHEMA, view)


def read_visits(spark: SparkSession, path: str, view: str | None = None) -> DataFrame:
    return read_table(spark, path, VISITS_SCHEMA, view)


def read_measurements(spark: SparkSession, path: str, view: str | None = None) -> DataFrame:
    return read_table(spark, path, MEASUREMENTS_SCHEMA, view)
