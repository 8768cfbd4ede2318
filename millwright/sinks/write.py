"""Writers that count what they write."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.gates import require


@dataclass(frozen=True)
class Written:
    """A stored table and the counters taken while it was written."""

    path: str
    counters: dict
    buckets: int | None = None


def write_counted(
    df: DataFrame,
    path: str,
    counters: Sequence[Column] = (),
    bucket_by: str | None = None,
    buckets: int | None = None,
    partition_by: str | None = None,
    sort_by: Sequence[str] | None = None,
) -> Written:
    """Write ``df`` as a new Snappy Parquet table and check that everything arrived.

    The counters sit directly below the writer, in the stage whose task results count exactly
    once, so a lost executor cannot inflate them. ``rows`` is always among them and is compared
    with the rows read back. Rows of a bucket are sorted by ``sort_by``, or else by the bucket column.
    """
    spark = df.sparkSession
    watch = Observation(f"write-{uuid.uuid4().hex}")
    if buckets:
        order = list(sort_by or [bucket_by])
        df = df.repartition(buckets, bucket_by)  # the writer sorts; a sort before it would hold all rows once more
    counted = df.observe(watch, F.count(F.lit(1)).alias("rows"), *counters)
    writer = counted.write.option("compression", "snappy")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    if buckets:
        name = f"bucketed_{uuid.uuid4().hex}"
        writer.format("parquet").bucketBy(buckets, bucket_by).sortBy(*order).option("path", path).saveAsTable(name)
        spark.sql(f"DROP TABLE {name}")  # the files stay: the table is external
    else:
        writer.parquet(path)
    counts = watch.get
    stored = spark.read.schema(df.schema).parquet(path).count()
    require(stored == counts["rows"], f"{path}: wrote {counts['rows']:,} rows, {stored:,} are stored")
    return Written(path, counts, buckets)


def write_report(report: DataFrame, path: str) -> None:
    """The one-row report as a JSON document."""
    report.coalesce(1).write.json(path)
