"""Every registered query: ``(spark, sf_dir) -> DataFrame`` over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import millwright as mw
from millwright.contracts import ID, Expected
from millwright.operators import gates
from millwright.plans import diagnostics, profiles
from millwright.sinks import current_tables

from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]

_registry: dict[str, Query] = {}


def query(function: Query) -> Query:
    _registry[function.__name__] = function
    return function


def registered() -> dict[str, Query]:
    return dict(_registry)


def _core(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return fx.parts(spark, sf), fx.station_visits(spark, sf)


def _labelled(source: str, df: DataFrame) -> DataFrame:
    return df.select(F.lit(source).alias("source"), "*")


def _union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# --- outcome metrics ---------------------------------------------------------------------------


@query
def overall_quality(spark, sf):
    return mw.overall_quality(fx.parts(spark, sf))


@query
def station_exposure(spark, sf):
    return mw.station_exposure(*_core(spark, sf))


@query
def station_table(spark, sf):
    return mw.station_table(mw.station_exposure(*_core(spark, sf)))


@query
def top_stations(spark, sf):
    return mw.top_stations(*_core(spark, sf))


@query
def production_paths(spark, sf):
    return mw.production_paths(*_core(spark, sf))


@query
def paths_by_volume(spark, sf):
    return mw.paths_by_volume(mw.production_paths(*_core(spark, sf)))


# --- investigation of one station --------------------------------------------------------------


@query
def target_vs_line(spark, sf):
    return mw.target_vs_line(*_core(spark, sf))


@query
def target_vs_line_by_rate(spark, sf):
    return mw.target_vs_line(*_core(spark, sf), by_rate=True)


@query
def target_within_line_group(spark, sf):
    return mw.target_within_line_group(*_core(spark, sf))


@query
def target_within_cohort(spark, sf):
    return mw.target_within_cohort(*_core(spark, sf))


@query
def part_route_profile(spark, sf):
    return mw.route_flags(mw.part_routes(fx.station_visits(spark, sf)))


@query
def time_cohorts(spark, sf):
    return mw.time_cohorts(fx.station_visits(spark, sf)).select(
        "part_id", F.col("visited_target").cast("int").alias("visited_target"), "first_line_time", "time_cohort"
    )


# --- wide sources to long tables ---------------------------------------------------------------


@query
def build_parts(spark, sf):
    return mw.build_parts(fx.wide_source(spark, sf, "numeric"))


@query
def build_station_visits(spark, sf):
    return mw.build_station_visits(fx.wide_source(spark, sf, "dates"))


@query
def build_mapped_measurements(spark, sf):
    return mw.build_mapped_measurements(*fx.wide_sources(spark, sf))


@query
def published_parts(spark, sf):
    return mw.snapshot_table(spark, fx.published(spark, sf), "parts")


@query
def published_station_visits(spark, sf):
    return mw.snapshot_table(spark, fx.published(spark, sf), "station_visits")


@query
def published_measurements(spark, sf):
    return mw.snapshot_table(spark, fx.published(spark, sf), "mapped_measurements")


# --- outcome metrics on the published tables: laid out by part, joined without an exchange ------


def _published(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return published_parts(spark, sf), published_station_visits(spark, sf)


@query
def published_station_exposure(spark, sf):
    return mw.station_exposure(*_published(spark, sf))


@query
def published_top_stations(spark, sf):
    """A threshold that more than fifteen stations reach, so that the limit cuts."""
    return mw.top_stations(*_published(spark, sf), min_parts=50)


@query
def published_production_paths(spark, sf):
    return mw.production_paths(*_published(spark, sf))


@query
def published_target_vs_line(spark, sf):
    return mw.target_vs_line(*_published(spark, sf))


@query
def published_target_within_line_group(spark, sf):
    return mw.target_within_line_group(*_published(spark, sf))


# --- the same from the station sets kept with the visits -----------------------------------------


def _sets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return published_parts(spark, sf), mw.snapshot_table(spark, fx.published(spark, sf), "station_sets")


@query
def kept_station_profile(spark, sf):
    return mw.set_profile(*_sets(spark, sf))


@query
def kept_production_paths(spark, sf):
    parts, sets = _sets(spark, sf)
    return mw.production_paths(parts, None, routes=mw.set_routes(sets))


@query
def kept_target_within_line_group(spark, sf):
    parts, sets = _sets(spark, sf)
    return mw.target_within_line_group(parts, None, routes=mw.set_routes(sets))


@query
def kept_parts_without_visits(spark, sf):
    return mw.parts_without_stations(fx.parts_more(spark, sf), _sets(spark, sf)[1])


# --- measurements ------------------------------------------------------------------------------


def _kept(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    target = fx.published(spark, sf)
    return mw.snapshot_table(spark, target, "feature_totals"), mw.snapshot_table(spark, target, "measured_parts")


@query
def station_measurement_coverage(spark, sf):
    return mw.kept_station_coverage(*_kept(spark, sf))


@query
def measurement_coverage(spark, sf):
    return mw.measurement_coverage(*_kept(spark, sf))


@query
def line_measurement_coverage(spark, sf):
    """Distinct parts of all stations of a line: their bitmaps united."""
    return mw.measurement_coverage(*_kept(spark, sf), group=F.left("station", F.lit(2)))


@query
def measurement_validation(spark, sf):
    return mw.measurement_validation(published_measurements(spark, sf))


# --- gates and diagnostics ---------------------------------------------------------------------


@query
def load_diagnostics(spark, sf):
    return mw.load_diagnostics(fx.parts_more(spark, sf), fx.visits_more(spark, sf))


@query
def orphan_visits(spark, sf):
    return gates.unknown_parts(fx.visits_more(spark, sf), fx.parts(spark, sf), counted="visits")


@query
def orphan_probe(spark, sf):
    """Whether any visit refers to no part: for the visits as they are, and with strangers among them."""
    parts = fx.parts(spark, sf)
    cases = (("station_visits", fx.station_visits), ("visits_more", fx.visits_more))
    found = [(name, mw.has_unknown(visits(spark, sf), parts)) for name, visits in cases]
    return spark.createDataFrame(found, "visits_table string, has_orphans boolean")


@query
def parts_without_visits(spark, sf):
    return gates.parts_without(fx.parts_more(spark, sf), fx.station_visits(spark, sf))


@query
def invalid_time_order(spark, sf):
    return gates.invalid_time_order(fx.visits_bad_order(spark, sf))


@query
def key_violations(spark, sf):
    def rows(table: str, report: DataFrame) -> DataFrame:
        return gates.as_rows(report, "check_name", "violations").select(F.lit(table).alias("table_name"), "*")

    keys, labels, visits = fx.keys_raw(spark, sf), fx.labels_raw(spark, sf), fx.station_visits(spark, sf)
    return _union(
        rows("keys_raw", gates.key_report(keys, ["part_id", "line_no"])),
        rows("station_visits", gates.key_report(visits, ["part_id", "station"])),
        rows("labels_raw", gates.column_violations(labels, ["part_id", "response"], {"response": [0, 1]})),
        rows("station_visits", gates.column_violations(visits, ["part_id", "station"])),
    )


@query
def source_alignment(spark, sf):
    return mw.source_alignment(*fx.dirty_ids(spark, sf), "part_id")


@query
def ingestion_report(spark, sf):
    target = fx.published(spark, sf)
    report = mw.ingestion_report(
        mw.snapshot_table(spark, target, "parts"),
        mw.snapshot_table(spark, target, "station_visits"),
        published_measurements(spark, sf),
        *fx.wide_catalogs(spark, sf),
        expected=Expected(mapped_features=312, numeric_columns=366, date_columns=625),
        clock=False,
        counted_measurements=current_tables(spark, target)["mapped_measurements"]["rows"],
    )
    return diagnostics.report_rows(report)


# --- profiles of the sources -------------------------------------------------------------------


@query
def id_profile(spark, sf):
    numeric, dates = fx.wide_sources(spark, sf)
    raw = fx.keys_raw(spark, sf).select(F.col("part_id").alias(ID))
    return _union(
        _labelled("numeric", mw.id_profile(numeric)),
        _labelled("dates", mw.id_profile(dates)),
        _labelled("keys_raw", mw.id_profile(raw)),
    )


@query
def label_counts(spark, sf):
    return mw.label_counts(fx.labels_raw(spark, sf), "response")


@query
def id_set_difference(spark, sf):
    return mw.id_set_difference(fx.parts_more(spark, sf), fx.date_ids_more(spark, sf), "part_id")


def _coverage(spark, sf) -> list[tuple[str, DataFrame]]:
    numeric, dates = fx.wide_sources(spark, sf)
    return [("numeric", mw.column_coverage(numeric)), ("dates", mw.column_coverage(dates))]


@query
def column_coverage(spark, sf):
    return _union(*[_labelled(name, coverage) for name, coverage in _coverage(spark, sf)])


@query
def coverage_distribution(spark, sf):
    return _union(*[_labelled(name, mw.coverage_distribution(c)) for name, c in _coverage(spark, sf)])


def _station_profile(spark, sf) -> DataFrame:
    numeric, dates = fx.wide_sources(spark, sf)
    return mw.station_profile(dates, numeric)


@query
def station_profile(spark, sf):
    return _station_profile(spark, sf)


@query
def most_visited_stations(spark, sf):
    return profiles.most_visited(_station_profile(spark, sf))


@query
def least_visited_stations(spark, sf):
    return profiles.least_visited(_station_profile(spark, sf))


# --- SQL text ----------------------------------------------------------------------------------

BATCH = """
-- failed visits per line; the view is the first statement, the report the last one
CREATE OR REPLACE VIEW visit_outcomes AS
SELECT /*+ MERGE(p) */ v.part_id, v.station, p.response, 'a;b' AS note, 'it\\'s; x' AS quoted
FROM station_visits v JOIN parts p ON p.part_id = v.part_id;

SELECT LEFT(station, 2) AS line, CAST(1.10 AS STRING) AS exact,
       COUNT(*) AS visits,
       COUNT(DISTINCT part_id) AS parts,
       COUNT(*) FILTER (WHERE response = 1) AS failed_visits,
       ROUND(100D * SUM(response) / COUNT(*), 3) AS failed_pct
FROM visit_outcomes
WHERE note = 'a;b' AND quoted = 'it\\'s; x'
GROUP BY 1
ORDER BY 1;
"""


@query
def sql_batch(spark, sf):
    parts, visits = _core(spark, sf)
    parts.createOrReplaceTempView("parts")
    visits.createOrReplaceTempView("station_visits")
    return mw.run_sql(spark, BATCH)


@query
def metric_views(spark, sf):
    """The registered metric views read through SQL."""
    mw.register_metric_views(*_core(spark, sf))
    return mw.run_sql(
        spark,
        "SELECT station, rate_vs_overall, (SELECT parts_processed FROM overall_quality_metrics) AS parts_processed "
        "FROM station_exposure_metrics",
    )
