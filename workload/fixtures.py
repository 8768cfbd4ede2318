"""Manufacturing-shaped tables derived from the given order tables.

A station number ``k`` is ``l_partkey % 61``, where the nine numbers beyond the last station count as
the last nine stations once more: every line item is an observation. Orphans and gaps come from ids that are
added, never from rows left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.contracts import ID, LABEL
from millwright.operators.catalog import column_catalog
from millwright.plans.loads import load_measurements, refresh
from millwright.session import scratch_path
from millwright.sources import read_header, read_wide_csv

STATIONS = 52
SLOTS = 7  # measurement columns per station
TIMED_SLOTS = 6  # the last slot has no time columns


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hours(ts: Column) -> Column:
    """Hours since 1970 of a wall-clock timestamp, whatever the session time zone is."""
    micros = (
        F.unix_date(F.to_date(ts)).cast("long") * F.lit(86_400_000_000)
        + F.hour(ts) * F.lit(3_600_000_000)
        + F.minute(ts) * F.lit(60_000_000)
        + (F.date_part(F.lit("SECOND"), ts) * F.lit(1_000_000)).cast("long")
    )
    return micros / F.lit(3.6e9)


def station_name(k: Column) -> Column:
    line = F.when(k <= 23, "L0").when(k <= 25, "L1").when(k <= 28, "L2").otherwise("L3")
    return F.concat(line, F.lit("_S"), k.cast("string"))


def station_label(k: int) -> str:
    return f"L{0 if k <= 23 else 1 if k <= 25 else 2 if k <= 28 else 3}_S{k}"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("part_id"), F.when(failed, 1).otherwise(0).cast("byte").alias("response")
    )


def observed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("l_partkey") % 61
    return (
        table(spark, sf_dir, "lineitem")
        .withColumn("k", F.when(number < STATIONS, number).otherwise(number - (61 - STATIONS)))
        .withColumnRenamed("l_orderkey", "part_id")
    )


def station_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Grouped by station number and raw timestamp: names and hours are made once per visit.
    return (
        observed_lines(spark, sf_dir)
        .groupBy("part_id", "k")
        .agg(F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"))
        .select(
            "part_id",
            station_name(F.col("k")).alias("station"),
            hours(F.col("first")).alias("first_observed_time"),
            hours(F.col("last")).alias("last_observed_time"),
        )
    )


LINES_PER_TASK = 250_000  # of line items gathered by part: what their sorts and tables hold fits the memory of a task


def part_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Partitions to gather line items by part in: as many as the session asks for, and more for larger tables."""
    few = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(few, -(-table(spark, sf_dir, "lineitem").count() // LINES_PER_TASK))


def cells(spark: SparkSession, sf_dir: str, tasks: int, *fields: str) -> DataFrame:
    """One row per part and slot of a station with the named ones of its value ``v`` and its times ``t1`` and ``t2``.

    The line items cross one shuffle, with these fields only and not without any, to the partition of their part.
    Hardly two of them share a cell, so nothing is gained by combining them before. Those without a slot, and those
    that another line number puts into the same one, are kept apart: no map of a part's cells can be made of them.
    """
    h = hours(F.col("l_shipdate"))
    untimed = F.col("l_linenumber") == 7
    no_t1 = untimed | ((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "O"))
    found = {
        "v": F.when(F.col("l_discount") != 0, F.col("l_extendedprice")),
        "t1": F.when(~no_t1, h),
        "t2": F.when(~untimed, h + F.col("l_quantity")),
    }
    extreme = {"v": F.min, "t1": F.min, "t2": F.max}
    number = F.col("l_linenumber")
    rows = observed_lines(spark, sf_dir).select(
        "part_id",
        (F.col("k") * SLOTS + number - 1).cast("int").alias("slot"),
        F.when(~number.between(1, SLOTS), number).alias("odd"),
        *[found[f].alias(f) for f in fields],
    )
    wanted = F.col("slot").isNull() | F.col("odd").isNotNull() | F.coalesce(*fields).isNotNull()
    by_part = rows.where(wanted).repartition(tasks, "part_id")
    return by_part.groupBy("part_id", "slot", "odd").agg(*[extreme[f](f).alias(f) for f in fields])


def supplier_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that no order has, one for each supplier."""
    return table(spark, sf_dir, "supplier").select((-F.col("s_suppkey").cast("long")).alias("part_id"), "s_nationkey")


def customer_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other ids that no order has, one for each customer."""
    return table(spark, sf_dir, "customer").select((-1_000_000_000 - F.col("c_custkey").cast("long")).alias("part_id"))


def parts_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts, and parts that were never seen anywhere."""
    unseen = supplier_ids(spark, sf_dir).select("part_id", F.lit(0).cast("byte").alias("response"))
    return parts(spark, sf_dir).unionByName(unseen)


def date_ids_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of all parts, and ids that no part has."""
    return parts(spark, sf_dir).select("part_id").unionByName(customer_ids(spark, sf_dir))


def dirty_ids(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two id columns that differ in every way: ids on one side only, repeated ids, and missing ones."""
    nothing = F.lit(None).cast("long").alias("part_id")
    again = supplier_ids(spark, sf_dir).where("s_nationkey < 12").select("part_id")
    left = parts_more(spark, sf_dir).select("part_id").unionAll(again).unionAll(table(spark, sf_dir, "nation").select(nothing))
    return left, date_ids_more(spark, sf_dir).unionAll(table(spark, sf_dir, "region").select(nothing))


def labels_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    pid = F.col("part_id")
    response = F.when(pid % 97 == 0, F.lit(None)).when(pid % 89 == 0, 2).otherwise(F.col("response"))
    return parts(spark, sf_dir).select("part_id", response.cast("int").alias("response"))


def visits_bad_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    swap = F.col("part_id") % 31 == 0
    first, last = F.col("first_observed_time"), F.col("last_observed_time")
    return station_visits(spark, sf_dir).select(
        "part_id",
        "station",
        F.when(swap, last).otherwise(first).alias("first_observed_time"),
        F.when(swap, first).otherwise(last).alias("last_observed_time"),
    )


def visits_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All visits, some with swapped bounds, and one visit of every id that no part has."""
    strangers = customer_ids(spark, sf_dir).select(
        "part_id",
        F.lit("L0_S0").alias("station"),
        F.lit(0.0).alias("first_observed_time"),
        F.lit(1.0).alias("last_observed_time"),
    )
    return visits_bad_order(spark, sf_dir).unionByName(strangers)


def keys_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("part_id"), F.col("l_linenumber").alias("line_no")
    )


def wide_frame(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """One of the two wide sources, ``numeric`` or ``dates``: one row per order, also for orders without any cell."""
    labels = parts(spark, sf_dir)
    # Each side moves its own fields only. At most STATIONS * SLOTS cells per part, so the per-part maps
    # are bounded by construction.
    fields = ("v",) if side == "numeric" else ("t2", "t1")
    tasks = part_tasks(spark, sf_dir)
    per_part = (
        cells(spark, sf_dir, tasks, *fields)
        .groupBy("part_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("slot", F.struct(*fields)))).alias("by_slot"))
    )
    # The input tables may hold one row group each; spelling out a thousand columns needs more tasks. The line items
    # of a part lie in the partition of the same number, so that they meet it without moving again.
    spread = labels.repartition(tasks, "part_id")
    joined = spread.join(per_part, "part_id", "left").withColumnRenamed("part_id", ID)

    # SQL text instead of Column calls: a thousand columns are then planned in one go.
    def cell(k: int, j: int, field: str, name: str) -> str:
        return f"try_element_at(by_slot, {k * SLOTS + j - 1}).{field} AS `{name}`"

    if side == "numeric":
        numeric = [cell(k, j, "v", f"{station_label(k)}_F{2 * j}") for k in range(STATIONS) for j in range(1, SLOTS + 1)]
        return joined.selectExpr(ID, *numeric, f"CAST(response AS INT) AS {LABEL}")
    dates = [
        cell(k, j, field, f"{station_label(k)}_D{2 * j + odd}")
        for k in range(STATIONS)
        for j in range(1, TIMED_SLOTS + 1)
        for odd, field in enumerate(fields)
    ]
    return joined.selectExpr(ID, *dates)


ROWS_PER_FILE = 100_000  # a compressed file is read by one task

_written: dict[tuple[str, str, str], str] = {}


def wide_file(spark: SparkSession, sf_dir: str, side: str) -> str:
    """Path of a wide source as CSV, written once per session below the shared folder, when it is first asked for.

    Nearly all of a sparse row is separators: compressed, they are hardly anything.
    """
    key = (spark.sparkContext.applicationId, sf_dir, side)
    if key not in _written:
        path = f"{scratch_path(spark, 'wide')}/{side}.csv"
        writer = wide_frame(spark, sf_dir, side).write.option("header", True).option("maxRecordsPerFile", ROWS_PER_FILE)
        writer.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").csv(path)
        _written[key] = path
    return _written[key]


def wide_source(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """A wide source scanned from CSV, as a user would read it."""
    return read_wide_csv(spark, wide_file(spark, sf_dir, side))


def wide_sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Both wide sources."""
    return wide_source(spark, sf_dir, "numeric"), wide_source(spark, sf_dir, "dates")


def wide_catalogs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return tuple(column_catalog(spark, read_header(spark, wide_file(spark, sf_dir, side))) for side in ("numeric", "dates"))


_published: dict[tuple[str, str], str] = {}


def published(spark: SparkSession, sf_dir: str) -> str:
    """Folder with parts, visits and measurements loaded from the wide sources, once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _published:
        target = scratch_path(spark, "published")
        numeric, dates = wide_sources(spark, sf_dir)
        refresh(spark, target, numeric, dates)
        load_measurements(spark, target, numeric, dates, expected_pairs=STATIONS * TIMED_SLOTS, view=None)
        _published[key] = target
    return _published[key]
