"""The column catalog: a wide header as a small DataFrame, and what its names mean."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contracts import ID, LABEL
from ..functions.naming import FEATURE_PATTERN, mapped_date_name, station_of

CATALOG_SCHEMA = T.StructType(
    [T.StructField("position", T.IntegerType(), False), T.StructField("column_name", T.StringType(), False)]
)


class Pair(NamedTuple):
    """A measurement column and the time column it is read with."""

    feature: str
    station: str
    date: str


def column_catalog(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """``position, column_name, station`` for each column, in header order."""
    rows = spark.createDataFrame(list(enumerate(names)), CATALOG_SCHEMA)
    return rows.withColumn("station", F.when(~F.col("column_name").isin(ID, LABEL), station_of(F.col("column_name"))))


def feature_mapping(numeric: DataFrame, dates: DataFrame) -> DataFrame:
    """Measurement columns of ``numeric`` with the time column found in ``dates``, if any.

    Both arguments are column catalogs. Columns that do not follow the naming rule are no
    measurements and are left out; unmapped measurements stay with a NULL time column.
    """
    features = numeric.where(F.col("column_name").rlike(FEATURE_PATTERN)).select(
        "position",
        F.col("column_name").alias("feature_name"),
        F.regexp_extract("column_name", FEATURE_PATTERN, 1).alias("station"),
        mapped_date_name(F.col("column_name")).alias("wanted"),
    )
    present = dates.select(F.col("column_name").alias("date_feature_name")).distinct()
    return features.join(present, F.col("wanted") == F.col("date_feature_name"), "left").select(
        "position",
        "feature_name",
        "station",
        "date_feature_name",
        F.col("date_feature_name").isNotNull().alias("mapped"),
    )


def mapped_pairs(mapping: DataFrame) -> list[Pair]:
    """The mapped pairs in header order, as plan parameters (bounded by the column count)."""
    rows = mapping.where("mapped").orderBy("position").collect()
    return [Pair(r["feature_name"], r["station"], r["date_feature_name"]) for r in rows]


def pairs_of(numeric: DataFrame, dates: DataFrame) -> list[Pair]:
    """Mapped pairs of two wide sources."""
    spark = numeric.sparkSession
    return mapped_pairs(feature_mapping(column_catalog(spark, numeric.columns), column_catalog(spark, dates.columns)))


def mapping_report(mapping: DataFrame, first: int = 10) -> DataFrame:
    """Mapped and unmapped measurement columns: how many, and the first few by position."""
    name = F.when(F.col("mapped"), F.concat_ws("->", "feature_name", "date_feature_name")).otherwise(
        F.col("feature_name")
    )
    listed = F.sort_array(F.collect_list(F.struct("position", name.alias("name"))))
    return (
        mapping.groupBy("mapped")
        .agg(F.count(F.lit(1)).alias("features"), F.slice(listed, 1, first)["name"].alias("first_features"))
        .orderBy(F.col("mapped").desc())
    )


def header_shape(catalog: DataFrame) -> DataFrame:
    """Column count and SHA-256 of the name list written as a JSON array (plain ASCII names)."""
    names = F.sort_array(F.collect_list(F.struct("position", "column_name")))["column_name"]
    text = F.concat(F.lit('["'), F.array_join(names, '", "'), F.lit('"]'))
    return catalog.agg(F.count(F.lit(1)).alias("columns"), F.sha2(text, 256).alias("header_sha256"))


def schema_stations(catalog: DataFrame) -> DataFrame:
    """Distinct stations named by a header, sorted, with their column counts."""
    return (
        catalog.where(F.col("station").isNotNull())
        .groupBy("station")
        .agg(F.count(F.lit(1)).alias("columns"))
        .orderBy("station")
    )
