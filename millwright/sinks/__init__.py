"""Sinks: staged Parquet tables, the published snapshot and the JSON report."""

from .publish import (
    LeaseHeld,
    current_tables,
    path_exists,
    publish_tables,
    ready_runs,
    register_snapshot,
    remove_path,
    resume_publication,
    snapshot_table,
)
from .write import Written, write_counted, write_report

__all__ = [
    "LeaseHeld",
    "Written",
    "current_tables",
    "path_exists",
    "publish_tables",
    "ready_runs",
    "register_snapshot",
    "remove_path",
    "resume_publication",
    "snapshot_table",
    "write_counted",
    "write_report",
]
