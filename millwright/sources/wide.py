"""Readers for the wide sources: ``Id``, hundreds of sparse double columns, maybe a label."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contracts import ID, LABEL

# Every file is checked against the schema by column name, and any cell that is not a number
# fails the read. `nullValue` also replaces empty cells, so this one setting makes both an empty
# cell and the word NaN missing without an expression per column.
CSV_OPTIONS = {
    "header": "true",
    "mode": "FAILFAST",
    "enforceSchema": "false",
    "nullValue": "NaN",
    "positiveInf": "inf",
    "negativeInf": "-inf",
}


def read_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV source, in file order (only the first line is fetched)."""
    first = spark.read.text(path).first()
    if first is None:
        raise ValueError(f"{path} has no header line")
    return next(csv.reader([first[0].lstrip("﻿")]))


def wide_schema(names: Sequence[str]) -> T.StructType:
    """Schema of a wide source from its column names; no inference pass over the data."""
    kinds = {ID: T.LongType(), LABEL: T.IntegerType()}
    return T.StructType([T.StructField(name, kinds.get(name, T.DoubleType())) for name in names])


def read_wide_csv(
    spark: SparkSession,
    path: str,
    names: Sequence[str] | None = None,
    missing_words: Sequence[str] = (),
) -> DataFrame:
    """Typed scan of a wide CSV source; only the columns a query uses are parsed.

    Empty cells and ``NaN`` are missing. ``missing_words`` names further spellings (``NA``,
    ``null``, ...); the cells are then read as text first, and other text still fails the read.
    """
    schema = wide_schema(names or read_header(spark, path))
    if not missing_words:
        return spark.read.schema(schema).options(**CSV_OPTIONS).csv(path)
    as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    raw = spark.read.schema(as_text).options(**CSV_OPTIONS).csv(path)
    words = list(missing_words)
    return raw.select(
        *[
            F.when(~F.col(f"`{f.name}`").isin(words), F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def read_wide_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Wide source kept as Parquet; NaN cells are made NULL, as everywhere else."""
    df = spark.read.parquet(path)
    return df.select(
        *[
            F.nanvl(F.col(f"`{f.name}`"), F.lit(None).cast(f.dataType)).alias(f.name)
            if isinstance(f.dataType, T.FractionalType) and not isinstance(f.dataType, T.DecimalType)
            else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


def feature_columns(df: DataFrame) -> list[str]:
    """Every column but the identity and the label, in source order."""
    return [name for name in df.columns if name not in (ID, LABEL)]


def first_parts(df: DataFrame, n: int, key: str = ID) -> DataFrame:
    """Sampling scan: ``n`` rows with the smallest ids, all rows if there are fewer.

    File order is not a property of a distributed read, so the sample is defined by id. Rows without
    an id come last; among rows of the last id any may be taken.
    """
    return df.orderBy(F.col(key).asc_nulls_last()).limit(n)
