"""Load diagnostics and the ingestion report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contracts import Expected, GateError
from ..operators.catalog import feature_mapping, header_shape
from ..operators.gates import as_rows
from .measurements import measurement_validation


def visit_totals(visits: DataFrame) -> DataFrame:
    """Visits, distinct stations and swapped bounds, counted per station first."""
    per_station = visits.groupBy("station").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("first_observed_time") > F.col("last_observed_time")).alias("swapped"),
    )
    return per_station.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("station_visits"),
        F.count("station").alias("distinct_stations"),
        F.coalesce(F.sum("swapped"), F.lit(0)).alias("invalid_time_order"),
    )


def coverage_totals(parts: DataFrame, visits: DataFrame) -> DataFrame:
    """Parts without visits and visits without a part: both anti joins as one outer join.

    Visits are counted per part first; the join moves one row per part on either side.
    """
    known = parts.select("part_id", F.lit(True).alias("known"))
    per_part = visits.groupBy("part_id").agg(F.count(F.lit(1)).alias("n"))
    return known.join(per_part, "part_id", "full_outer").agg(
        F.count_if(F.col("known") & F.col("n").isNull()).alias("parts_without_visits"),
        F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0)).alias("orphan_visits"),
    )


def load_diagnostics(parts: DataFrame, visits: DataFrame) -> DataFrame:
    """Seven named counts over the loaded tables, as ``check, value`` rows."""
    part_totals = parts.agg(
        F.count(F.lit(1)).alias("parts"), F.count_if(F.col("response") == 1).alias("failures")
    )
    return (
        as_rows(part_totals)
        .unionAll(as_rows(visit_totals(visits)))
        .unionAll(as_rows(coverage_totals(parts, visits)))
    )


def ingestion_report(
    parts: DataFrame,
    visits: DataFrame,
    measurements: DataFrame,
    numeric_catalog: DataFrame,
    date_catalog: DataFrame,
    stored_measurements: DataFrame | None = None,
    expected: Expected = Expected(),
    numeric_name: str = "train_numeric.csv",
    date_name: str = "train_date.csv",
    clock: bool = True,
    counted_measurements: int | None = None,
) -> DataFrame:
    """One row with the structs ``source`` and ``loaded``, a note, the ``checks`` map and ``status``.

    The rows of ``measurements``, read back from storage, must be as many as the load counted:
    ``counted_measurements``, or else the rows of ``stored_measurements``. Without either the check
    fails, since nothing was compared. Every part of the report is a one-row aggregate read as a scalar subquery.
    """
    if counted_measurements is not None:
        counted = F.lit(counted_measurements).cast("bigint")
    elif stored_measurements is not None:
        counted = stored_measurements.agg(F.count(F.lit(1))).scalar()
    else:
        counted = F.lit(None).cast("bigint")

    def one(df: DataFrame):
        return df.select(F.struct("*")).scalar()

    mapped = feature_mapping(numeric_catalog, date_catalog)
    totals = parts.sparkSession.range(1).select(
        one(parts.agg(F.count(F.lit(1)).alias("parts"), F.sum("response").alias("failed_parts"))).alias("p"),
        one(visit_totals(visits)).alias("v"),
        one(measurement_validation(measurements)).alias("m"),
        counted.alias("counted_rows"),
        one(header_shape(numeric_catalog)).alias("n"),
        one(header_shape(date_catalog)).alias("d"),
        one(mapped.agg(F.count_if("mapped").alias("timed"), F.count_if(~F.col("mapped")).alias("untimed"))).alias("f"),
    )
    c = F.col
    # The names of the checks and of the report's fields.
    same = {
        "part_count": c("p.parts") == expected.parts,
        "failure_count": c("p.failed_parts") == expected.failed_parts,
        "station_count": c("v.distinct_stations") == expected.stations,
        "measurement_count_matches_parquet": c("m.measurements") == c("counted_rows"),
        "mapped_feature_count": c("m.features") == expected.mapped_features,
        "matched_times_present": c("m.missing_times") == expected.missing_times,
        "numeric_header_shape": c("n.columns") == expected.numeric_columns,
        "date_header_shape": c("d.columns") == expected.date_columns,
    }
    entries = [item for name, holds in same.items() for item in (F.lit(name), F.coalesce(holds, F.lit(False)))]
    report = totals.select(
        F.struct(
            F.lit(numeric_name).alias("numeric_file"),
            c("n.columns").alias("numeric_columns"),
            c("n.header_sha256").alias("numeric_header_sha256"),
            F.lit(date_name).alias("date_file"),
            c("d.columns").alias("date_columns"),
            c("d.header_sha256").alias("date_header_sha256"),
        ).alias("source"),
        F.struct(
            c("p.parts").alias("parts"),
            c("p.failed_parts").alias("failed_parts"),
            c("v.station_visits").alias("station_observations"),
            c("v.distinct_stations").alias("distinct_stations"),
            c("m.measurements").alias("mapped_measurements"),
            c("m.features").alias("mapped_features"),
            c("m.missing_times").alias("missing_matched_times"),
        ).alias("loaded"),
        F.format_string(
            "%d numeric features have a matching date column and were loaded; %d other feature columns "
            "stay in the source file because no measurement time is known for them.",
            c("f.timed"),
            c("f.untimed"),
        ).alias("coverage_note"),
        F.create_map(*entries).alias("checks"),
    ).withColumn(
        "status",
        F.when(F.forall(F.map_values("checks"), lambda holds: holds), F.lit("passed")).otherwise(F.lit("failed")),
    )
    if not clock:
        return report
    utc = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    created = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("created_utc")
    return report.select(created, "*")


def report_rows(report: DataFrame) -> DataFrame:
    """The nested report as ``section, name, value`` text rows."""

    def struct_rows(section: str):
        fields = report.schema[section].dataType.names
        return [
            F.struct(
                F.lit(section).alias("section"),
                F.lit(f).alias("name"),
                F.col(f"{section}.{f}").cast("string").alias("value"),
            )
            for f in fields
        ]

    checks = F.transform(
        F.map_entries("checks"),
        lambda e: F.struct(
            F.lit("checks").alias("section"), e["key"].alias("name"), e["value"].cast("string").alias("value")
        ),
    )
    status = F.struct(F.lit("status").alias("section"), F.lit("status").alias("name"), F.col("status").alias("value"))
    note = F.struct(
        F.lit("note").alias("section"), F.lit("coverage_note").alias("name"), F.col("coverage_note").alias("value")
    )
    fixed = F.array(*struct_rows("source"), *struct_rows("loaded"), note, status)
    return report.select(F.inline(F.concat(fixed, checks)))


def require_passed(report: DataFrame) -> None:
    """Fails when any check of a (small, already written) report did not hold."""
    row = report.select("status", "checks").first()
    if row["status"] != "passed":
        raise GateError(f"failed checks: {sorted(k for k, ok in row['checks'].items() if not ok)}")
