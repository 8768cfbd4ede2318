"""Production-line outcome analytics on Spark."""

from .contracts import Expected, GateError
from .operators.catalog import column_catalog, feature_mapping, header_shape, mapping_report, schema_stations
from .operators.gates import first_unknown, has_unknown, source_alignment
from .operators.reshape import mapped_measurements, station_visits
from .operators.routes import part_routes, route_flags
from .operators.stationsets import parts_without_stations, set_profile, set_routes, station_counts
from .operators.summary import failure_summary
from .operators.tiles import global_ntile
from .plans.diagnostics import ingestion_report, load_diagnostics
from .plans.investigate import target_vs_line, target_within_cohort, target_within_line_group, time_cohorts
from .plans.loads import (
    build_mapped_measurements,
    build_parts,
    build_station_visits,
    check_date_ids,
    check_parts,
    load_measurements,
    refresh,
)
from .plans.measurements import (
    kept_station_coverage,
    measurement_coverage,
    measurement_validation,
    station_measurement_coverage,
)
from .plans.metrics import (
    overall_quality,
    paths_by_volume,
    production_paths,
    register_metric_views,
    station_exposure,
    station_table,
    top_stations,
)
from .plans.profiles import (
    column_coverage,
    coverage_distribution,
    id_profile,
    id_set_difference,
    label_counts,
    station_profile,
)
from .plans.sqlbatch import run_sql
from .session import build_session
from .sinks import ready_runs, register_snapshot, resume_publication, snapshot_table, write_report
from .sources import first_parts, read_header, read_measurements, read_wide_csv, read_wide_parquet

__all__ = [
    "Expected",
    "GateError",
    "build_mapped_measurements",
    "build_parts",
    "build_session",
    "build_station_visits",
    "check_date_ids",
    "check_parts",
    "column_catalog",
    "column_coverage",
    "coverage_distribution",
    "failure_summary",
    "feature_mapping",
    "first_parts",
    "first_unknown",
    "global_ntile",
    "has_unknown",
    "header_shape",
    "id_profile",
    "id_set_difference",
    "ingestion_report",
    "kept_station_coverage",
    "label_counts",
    "load_diagnostics",
    "load_measurements",
    "mapped_measurements",
    "mapping_report",
    "measurement_coverage",
    "measurement_validation",
    "overall_quality",
    "part_routes",
    "parts_without_stations",
    "paths_by_volume",
    "production_paths",
    "read_header",
    "read_measurements",
    "read_wide_csv",
    "read_wide_parquet",
    "ready_runs",
    "refresh",
    "register_metric_views",
    "register_snapshot",
    "resume_publication",
    "route_flags",
    "run_sql",
    "schema_stations",
    "set_profile",
    "set_routes",
    "snapshot_table",
    "source_alignment",
    "station_counts",
    "station_exposure",
    "station_measurement_coverage",
    "station_profile",
    "station_table",
    "station_visits",
    "target_vs_line",
    "target_within_cohort",
    "target_within_line_group",
    "time_cohorts",
    "top_stations",
    "write_report",
]
