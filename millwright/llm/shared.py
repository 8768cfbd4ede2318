"""What the operators of this subpackage share: written tables, shipped code, file access in tasks."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from millwright.session import scratch_path

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SLICE_BYTES = 4 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Let Python workers that share this folder import the package.

    On a cluster without a shared installation pass the package with ``--py-files`` as well.
    """
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)


def written(df: DataFrame, label: str, clean: bool = False) -> DataFrame:
    """Write ``df`` below the shared folder and read it again: lineage ends here.

    Unlike a local checkpoint the rows survive a lost executor, and every later reader sees the
    same rows. With ``clean`` the shuffle files of the write go as soon as it is done, not when the driver
    happens to collect its garbage.
    """
    path = scratch_path(df.sparkSession, label)
    conf, before = df.sparkSession.conf, df.sparkSession.conf.get(CLEANUP, None)
    if clean:
        conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if clean:
            conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows of about ``SLICE_BYTES``."""
    rows = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def map_arrow(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[list[pa.Array]]], schema: StructType
) -> DataFrame:
    """``mapInArrow`` by position: ``function`` yields lists of arrays in the order of ``schema``.

    Column names never reach the function, so any name is allowed, dots included. Batches of many
    bytes are handed over in slices, so what the function holds at once stays small.
    """
    ship(df.sparkSession)
    inside = [f"c{i}" for i in range(len(schema.fields))]
    plain = StructType([StructField(n, f.dataType) for n, f in zip(inside, schema.fields, strict=True)])

    def run(batches):
        for columns in function(part for batch in batches for part in sliced(batch)):
            yield pa.RecordBatch.from_arrays(columns, names=inside)

    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(run, plain).toDF(*schema.names)


def running_totals(df: DataFrame, order: Sequence[str], value: str, group: str, label: str) -> DataFrame:
    """``df`` with ``before``: the sum of ``value`` over the rows ahead in ``order`` that share ``group``.

    ``order`` starts with ``group``; both it and ``value`` are bigint without nulls. Rows are
    range-partitioned on the whole order, so one large group spreads over many tasks, then written once
    with sums of their own partition. A group that crosses partitions has one offset in each of them, at
    most one crosses each border, and those few are sent to every task.
    """
    kept = [name for name in df.columns if name not in (group, value)]
    schema = df.select(group, value, *kept).schema
    local = StructType([StructField("part", LongType()), StructField("before", LongType()), *schema.fields])

    def run(batches):
        part, last, carry = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            groups, values = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
            before = np.cumsum(values) - values
            runs = np.diff(np.r_[starts, len(groups)])
            before -= np.repeat(before[starts], runs)
            if groups[0] == last:
                before[: runs[0]] += carry
            last, carry = groups[-1], int(before[-1] + values[-1])
            yield [pa.array(np.full(len(groups), part)), pa.array(before), *batch.columns]

    ordered = df.select(group, value, *kept).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(map_arrow(ordered, run, local), label)
    sums = rows.groupBy(group, "part").agg(F.sum(value).alias("held"))
    ahead = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.sum("held").over(ahead)).where(F.col("offset").isNotNull())
    found = rows.join(F.broadcast(offsets.select(group, "part", "offset")), [group, "part"], "left")
    return found.withColumn("before", F.col("before") + F.coalesce("offset", F.lit(0))).select(*df.columns, "before")


def without_columns(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns of such names, in any case."""
    taken = {name.lower() for name in names}
    return df.select(*[F.col(f"`{name}`") for name in df.columns if name.lower() not in taken])


def with_columns(df: DataFrame, **columns) -> DataFrame:
    """Add columns; a column that ``df`` already has under such a name, in any case, gives way."""
    kept = without_columns(df, *columns)
    return df.select(*[F.col(f"`{name}`") for name in kept.columns], *[c.alias(n) for n, c in columns.items()])


def same_columns(df: DataFrame, like: DataFrame) -> DataFrame:
    """``df`` with the columns of ``like`` only, in their order."""
    return df.select(*[F.col(f"`{name}`") for name in like.columns])
