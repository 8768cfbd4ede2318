"""Builds and loads: wide sources in, gated and published tables out.

Each wide source is parsed once, by a narrow job that writes a compact columnar copy. Every gate
then reads that copy, and nothing becomes current before all gates hold.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import ID, LABEL, TABLE_KEYS, VISIT_ORDER
from ..operators.catalog import pairs_of
from ..operators.gates import (
    require,
    require_aligned,
    require_columns,
    require_keys,
    require_known,
    require_rows,
    source_alignment,
)
from ..operators.reshape import (
    mapped_measurements,
    name_cells,
    number_stations,
    pack_times,
    pack_values,
    station_visits,
    time_columns,
    unfold_cells,
    unfold_visits,
    visits_per_part,
)
from ..sinks.publish import LeaseHeld, current_tables, declare_ready, entry_of, publish_tables, remove_path, stored_bytes
from ..sinks.write import Written, write_counted
from ..sources.tables import read_measurements, read_parts, read_visits
from .measurements import close_ids, feature_totals, measured_parts


def build_parts(numeric: DataFrame) -> DataFrame:
    """Part id and outcome from the wide numeric source; only two columns are read."""
    return numeric.select(F.col(ID).alias("part_id"), F.col(LABEL).cast("byte").alias("response"))


def check_parts(parts: DataFrame, expected_rows: int | None = None) -> int:
    """Ids present and unique, outcomes 0 or 1, and the expected number of rows; returns the rows."""
    require_columns(parts, "parts", ["part_id", "response"], {"response": [0, 1]})
    rows = require_keys(parts, TABLE_KEYS["parts"], "parts")
    require_rows(rows, expected_rows, "parts")
    return rows


def check_date_ids(ids: DataFrame, parts: DataFrame, expected_rows: int | None = None) -> int:
    """Date ids (column ``part_id``) present, unique, and those of all loaded parts; returns how many.

    One aggregate over both id sets answers all of it.
    """
    report = source_alignment(ids, parts, "part_id").first()
    require(report["null_ids"] == 0, f"date source: {report['null_ids']:,} rows without an id")
    require(report["duplicate_ids"] == 0, f"date source: {report['duplicate_ids']:,} repeated ids")
    require(report["left_only_ids"] == 0, f"date source: {report['left_only_ids']:,} ids are no loaded part")
    require(report["right_only_ids"] == 0, f"date source: {report['right_only_ids']:,} loaded parts are missing")
    require_rows(report["left_rows"], expected_rows, "date source")
    return report["left_rows"]


def build_station_visits(dates: DataFrame) -> DataFrame:
    """Visits of the wide date source; ids are checked by :func:`check_date_ids` or a load."""
    return station_visits(dates)


def build_mapped_measurements(
    numeric: DataFrame, dates: DataFrame, expected_pairs: int | None = None, check_ids: bool = True
) -> DataFrame:
    """Measurements of two wide sources that hold the same ids exactly once.

    Each source is scanned once. With ``check_ids``, ids that do not match one to one fail the result.
    """
    pairs = pairs_of(numeric, dates)
    require(expected_pairs in (None, len(pairs)), f"expected {expected_pairs} pairs, found {len(pairs)}")
    return mapped_measurements(numeric, dates, pairs, check_ids)


BUCKET_BYTES = 128 << 20  # of stored visits
LEAST_BUCKET_BYTES = 1 << 20  # below that, more buckets than cores bring nothing
BUCKET_VISITS = 4_000_000  # one task sorts them in memory, however few bytes they are stored in
MERGE_BYTES = 4 << 20  # of stored cells that one task merges: it sorts ten times as many


def measured_buckets(spark: SparkSession, path: str) -> int:
    """Buckets for a table whose rows are stored (in any layout) below ``path``."""
    return _pieces(spark, stored_bytes(spark, path), BUCKET_BYTES)


def merge_tasks(spark: SparkSession, *paths: str) -> int:
    """Tasks that merge the tables stored below ``paths``.

    Left to itself, Spark merges partitions but never splits one here, and goes by compressed bytes: the rows of a task
    then outgrow its memory with the tables, and are spilled.
    """
    return _pieces(spark, sum(stored_bytes(spark, path) for path in paths), MERGE_BYTES)


def _pieces(spark: SparkSession, size: int, most: int) -> int:
    few = min(spark.sparkContext.defaultParallelism, -(-size // LEAST_BUCKET_BYTES))
    return max(1, few, -(-size // most))


def _stage_parts(numeric: DataFrame, path: str, expected_rows: int | None) -> Written:
    """Two narrow columns of the wide source, gated; their final layout is known later."""
    failed = F.coalesce(F.sum("response"), F.lit(0)).alias("failed")
    # Two short columns per split of a very wide file: merged, or each split leaves a tiny file.
    written = write_counted(build_parts(numeric).hint("rebalance", "part_id"), path, [failed])
    stored = numeric.sparkSession.read.parquet(path)
    check_parts(stored, expected_rows)
    refound = stored.agg(F.coalesce(F.sum("response"), F.lit(0))).first()[0]
    require(refound == written.counters["failed"], "parts: stored failures differ from the ingested ones")
    return written


def _stage_dates(dates: DataFrame, parts: DataFrame, path: str, expected_rows: int | None) -> tuple[DataFrame, int]:
    """The visits of every part folded into one array, gated against the loaded parts, and how many visits."""
    loaded = parts.count()
    require(loaded > 0, "load parts before station visits")
    require_rows(loaded, expected_rows, "loaded parts")
    visits = F.coalesce(F.sum(F.size("visits")), F.lit(0)).alias("visits")
    written = write_counted(visits_per_part(dates), path, [visits])
    folded = dates.sparkSession.read.parquet(path)
    check_date_ids(folded, parts, expected_rows)
    return folded, written.counters["visits"]


def refresh(
    spark: SparkSession,
    target: str,
    numeric: DataFrame | None = None,
    dates: DataFrame | None = None,
    expected_rows: int | None = None,
    buckets: int | str | None = "measured",
) -> dict[str, int]:
    """Replace parts, station visits or both under ``target``, all or nothing.

    Give only ``numeric`` or only ``dates`` to refresh one table; the other one stays current and
    must still fit. Both tables are stored hashed by part into the same number of buckets, so
    that what joins or groups them by part needs no exchange. Inside a bucket visits lie by station, so that
    a report on one line reads the pages of that line only. The number of buckets follows from the stored bytes
    and the number of the visits; a refresh of one table keeps to it or lays out the other one anew. ``buckets`` sets it
    by hand, None stores plain files. The set of stations of every part is kept beside the visits, from the
    same scan of the dates; see :mod:`millwright.operators.stationsets`. Returns the totals.
    """
    require(numeric is not None or dates is not None, "nothing to refresh")
    run = uuid.uuid4().hex
    folder = f"{target}/runs/{run}"
    seen = current_tables(spark, target)
    tables = dict(seen)
    totals: dict[str, int] = {}
    try:
        if numeric is not None:
            staged = _stage_parts(numeric, f"{folder}/_parts", expected_rows)
            parts_path = staged.path
            totals |= {"parts": staged.counters["rows"], "failed_parts": staged.counters["failed"]}
        else:
            require("parts" in tables, "load parts before station visits")
            parts_path = tables["parts"]["path"]
        parts = read_parts(spark, parts_path)

        if dates is not None:
            folded, found = _stage_dates(dates, parts, f"{folder}/_folded_dates", expected_rows)
            if buckets == "measured":
                buckets = max(measured_buckets(spark, f"{folder}/_folded_dates"), -(-found // BUCKET_VISITS))
            visits = unfold_visits(folded)
            staged = write_counted(visits, f"{folder}/station_visits", (), "part_id", buckets, sort_by=VISIT_ORDER)
            tables["station_visits"] = entry_of(staged)
            totals["station_visits"] = staged.counters["rows"]
            sets = folded.select("part_id", "stations")
            entry = entry_of(write_counted(sets, f"{folder}/station_sets", (), "part_id", buckets))
            tables["station_sets"] = entry | {"stations": list(time_columns(dates))}
        else:
            if "station_visits" in tables:
                # Visits staged above were checked against these very parts; older ones were not.
                require_known(
                    read_visits(spark, tables["station_visits"]["path"]),
                    parts,
                    "station visits refer to parts that would no longer exist",
                )
            if buckets == "measured":
                now = tables.get("station_visits")
                buckets = now["buckets"] if now else measured_buckets(spark, parts_path)

        if numeric is not None or tables["parts"]["buckets"] != buckets:
            tables["parts"] = entry_of(write_counted(parts, f"{folder}/parts", (), "part_id", buckets))
        declare_ready(spark, target, run, tables, seen)
        publish_tables(spark, target, tables, seen)
    except LeaseHeld:
        raise  # the run is ready: `resume_publication` can finish it
    except Exception:
        remove_path(spark, folder)
        raise
    for scratch in ("_parts", "_folded_dates"):
        remove_path(spark, f"{folder}/{scratch}")
    return totals


def load_measurements(
    spark: SparkSession,
    target: str,
    numeric: DataFrame,
    dates: DataFrame,
    expected_pairs: int | None = None,
    expected_rows: int | None = None,
    view: str | None = "mapped_measurements",
) -> dict[str, int]:
    """One-shot load of the measurement table, laid out by station; never replaces a published one.

    The two sources must hold the same ids exactly once. Row order does not matter. The table is
    published beside the others, with the rows it was counted to have, together with its totals per
    feature and, if part ids lie close enough, with the measured parts of every station as bitmaps; see
    :mod:`millwright.plans.measurements`. Nothing but the pointer makes it current: a load that fails or
    is overtaken can be repeated.
    """
    seen = current_tables(spark, target)
    if "mapped_measurements" in seen:
        raise FileExistsError(f"{target} has mapped measurements; load into another target")
    pairs = pairs_of(numeric, dates)
    require(bool(pairs), "no measurement column has a matching time column")
    require(expected_pairs in (None, len(pairs)), f"expected {expected_pairs} pairs, found {len(pairs)}")

    run = uuid.uuid4().hex
    folder = f"{target}/runs/{run}"
    try:
        values = spark.read.parquet(write_counted(pack_values(numeric, pairs), f"{folder}/_values").path)
        times = spark.read.parquet(write_counted(pack_times(dates, pairs), f"{folder}/_times").path)
        parts = values.select("part_id")
        scanned = require_aligned(values, times, "part_id")
        require_rows(scanned, expected_rows, "wide sources")

        tasks = merge_tasks(spark, f"{folder}/_values", f"{folder}/_times")
        values, times = (side.repartition(tasks, "part_id") for side in (values, times))
        # Rebalancing splits a large station over several tasks and merges small ones.
        cells = number_stations(unfold_cells(values, times, pairs), pairs).hint("rebalance", "station_number")
        untimed = F.count_if(F.col("observed_time").isNull()).alias("untimed")
        written = write_counted(
            name_cells(cells, pairs), f"{folder}/mapped_measurements", [untimed], partition_by="station"
        )
        require(written.counters["rows"] > 0, "no measurements were found")
        tables = seen | {"mapped_measurements": entry_of(written)}
        stored = read_measurements(spark, written.path)
        tables["feature_totals"] = entry_of(write_counted(feature_totals(stored).coalesce(1), f"{folder}/feature_totals"))
        if close_ids(parts):
            tables["measured_parts"] = entry_of(
                write_counted(measured_parts(stored).hint("rebalance"), f"{folder}/measured_parts")
            )
        declare_ready(spark, target, run, tables, seen)
        publish_tables(spark, target, tables, seen)
    except LeaseHeld:
        raise  # the run is ready: `resume_publication` can finish it
    except Exception:
        remove_path(spark, folder)
        raise
    for scratch in ("_values", "_times"):
        remove_path(spark, f"{folder}/{scratch}")
    read_measurements(spark, written.path, view)
    return {
        "pairs": len(pairs),
        "parts": scanned,
        "measurements": written.counters["rows"],
        "missing_times": written.counters["untimed"],
    }
