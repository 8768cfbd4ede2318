"""Snapshot publication: tables are written aside and become current by one atomic rename.

``<target>/CURRENT`` is a small JSON file naming the path of every current table. It is the only
thing ever replaced. Tables are staged in ``<target>/runs/<run>``; a run whose gates all held leaves a
manifest there, so that a publication that was cut short can be taken up again. On object stores
without atomic rename, use a table format instead.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..contracts import (
    FEATURE_TOTALS_SCHEMA,
    MEASURED_PARTS_SCHEMA,
    MEASUREMENTS_SCHEMA,
    PARTS_SCHEMA,
    STATION_SETS_SCHEMA,
    VISIT_ORDER,
    VISITS_SCHEMA,
)
from ..operators.stationsets import named
from .write import Written

POINTER = "CURRENT"
MANIFEST = "READY"
LEASE_SECONDS = 300
SCHEMAS = {
    "parts": PARTS_SCHEMA,
    "station_visits": VISITS_SCHEMA,
    "station_sets": STATION_SETS_SCHEMA,
    "mapped_measurements": MEASUREMENTS_SCHEMA,
    "feature_totals": FEATURE_TOTALS_SCHEMA,
    "measured_parts": MEASURED_PARTS_SCHEMA,
}


class LeaseHeld(RuntimeError):
    """Someone else is publishing just now; what was staged can be published later."""


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, hadoop_path, hadoop_path.getFileSystem(conf)


def path_exists(spark: SparkSession, path: str) -> bool:
    _, hadoop_path, fs = _hadoop(spark, path)
    return fs.exists(hadoop_path)


def remove_path(spark: SparkSession, path: str) -> None:
    _, hadoop_path, fs = _hadoop(spark, path)
    fs.delete(hadoop_path, True)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files below ``path``."""
    _, hadoop_path, fs = _hadoop(spark, path)
    return fs.getContentSummary(hadoop_path).getLength()


def _read_json(spark: SparkSession, path: str) -> dict | None:
    """A small JSON file, or None if it is missing or was cut short."""
    _, hadoop_path, fs = _hadoop(spark, path)
    try:
        stream = fs.open(hadoop_path)
    except Exception:
        if fs.exists(hadoop_path):
            raise
        return None
    try:
        data = bytes(stream.readAllBytes())
    finally:
        stream.close()
    try:
        return json.loads(data)
    except ValueError:
        return None


def _write_json(spark: SparkSession, path: str, content: dict) -> None:
    """Create a small JSON file; fails if there is one."""
    _, hadoop_path, fs = _hadoop(spark, path)
    out = fs.create(hadoop_path, False)
    out.write(json.dumps(content).encode())
    out.close()


def current_tables(spark: SparkSession, target: str) -> dict[str, dict]:
    """What the pointer names now: table -> ``{"path", "buckets", "rows"}``; empty before the first load."""
    return _read_json(spark, f"{target}/{POINTER}") or {}


def _lease_of(spark: SparkSession, path: str) -> dict | None:
    """The lease in a file; None if its owner died while writing it, whatever reading it then says."""
    try:
        return _read_json(spark, path)
    except Exception:
        return None


def _take_lease(spark: SparkSession, path: str, owner: str, seconds: float) -> None:
    """Create the lease file, or take over one that has run out.

    A lease names its owner and the time it ends. One that is empty, because its owner died while
    writing it, ends ``seconds`` after the file was made. An ended lease is first renamed, which only
    one of several contenders can do.
    """
    _, lease, fs = _hadoop(spark, path)
    if fs.exists(lease):
        held = _lease_of(spark, path)
        ends = held["ends"] if held else fs.getFileStatus(lease).getModificationTime() / 1000 + seconds
        if ends > time.time():
            raise LeaseHeld(f"{held['owner'] if held else 'someone'} holds {path} for another {ends - time.time():.0f} s")
        _, ended, _ = _hadoop(spark, f"{path}-{owner}")
        if not fs.rename(lease, ended):
            raise LeaseHeld(f"another publication has just taken over {path}")
        if _lease_of(spark, f"{path}-{owner}") != held:  # a newer lease came in between
            fs.rename(ended, lease)
            raise LeaseHeld(f"another publication has just taken over {path}")
        fs.delete(ended, False)
    try:
        _write_json(spark, path, {"owner": owner, "ends": time.time() + seconds})
    except Exception as error:
        raise LeaseHeld(f"another publication has just taken {path}") from error


def publish_tables(
    spark: SparkSession, target: str, tables: dict[str, dict], seen: dict[str, dict], lease_seconds: float = LEASE_SECONDS
) -> None:
    """Make exactly these tables current, in one step, if those ``seen`` at the start still are.

    A lease, which only one publisher can hold, covers the comparison and the rename. If its holder
    dies, the next publication after its end goes on; the holder of an ended lease does not publish.
    """
    path, owner = f"{target}/_{POINTER}.lease", uuid.uuid4().hex
    _take_lease(spark, path, owner, lease_seconds)

    def mine() -> bool:
        held = _lease_of(spark, path)
        return bool(held) and held["owner"] == owner and held["ends"] > time.time()

    try:
        if current_tables(spark, target) != seen:
            raise RuntimeError(f"{target} was published by someone else meanwhile; load again")
        if not mine():
            raise LeaseHeld(f"the lease on {target} ended before the publication; publish again")
        _replace_pointer(spark, target, tables)
    finally:
        if mine():
            remove_path(spark, path)


def declare_ready(spark: SparkSession, target: str, run: str, tables: dict[str, dict], seen: dict[str, dict]) -> None:
    """Note in a run's folder what it will publish; written when all of its gates have held."""
    _write_json(spark, f"{target}/runs/{run}/{MANIFEST}", {"tables": tables, "seen": seen})


def ready_runs(spark: SparkSession, target: str) -> list[str]:
    """Runs that passed their gates, are not current, and still fit what is: they can be resumed."""
    _, runs, fs = _hadoop(spark, f"{target}/runs")
    if not fs.exists(runs):
        return []
    now = current_tables(spark, target)
    found = []
    for status in fs.listStatus(runs):
        manifest = _read_json(spark, f"{target}/runs/{status.getPath().getName()}/{MANIFEST}")
        if manifest and manifest["seen"] == now != manifest["tables"]:
            found.append(status.getPath().getName())
    return sorted(found)


def resume_publication(spark: SparkSession, target: str, run: str) -> dict[str, dict]:
    """Publish a run that was staged and checked but never became current; returns the current tables."""
    manifest = _read_json(spark, f"{target}/runs/{run}/{MANIFEST}")
    if manifest is None:
        raise LookupError(f"run {run} of {target} is not ready: it was not staged to its end")
    if current_tables(spark, target) != manifest["tables"]:
        publish_tables(spark, target, manifest["tables"], manifest["seen"])
    return manifest["tables"]


def _replace_pointer(spark: SparkSession, target: str, tables: dict[str, dict]) -> None:
    draft_path = f"{target}/_{POINTER}-{uuid.uuid4().hex}"
    _write_json(spark, draft_path, tables)
    jvm, final, fs = _hadoop(spark, f"{target}/{POINTER}")
    _, draft, _ = _hadoop(spark, draft_path)
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
    context.rename(draft, final, options)


def entry_of(written: Written) -> dict:
    return {"path": written.path, "buckets": written.buckets, "rows": written.counters["rows"]}


def _bucketed_table(spark: SparkSession, name: str, full_name: str, entry: dict) -> None:
    """A catalog table over published bucketed files; only the catalog knows their layout."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in SCHEMAS[name])
    order = ", ".join(VISIT_ORDER if name == "station_visits" else ["part_id"])
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {full_name} ({columns}) USING parquet "
        f"CLUSTERED BY (part_id) SORTED BY ({order}) INTO {int(entry['buckets'])} BUCKETS "
        f"LOCATION '{entry['path']}'"
    )


def snapshot_table(spark: SparkSession, target: str, name: str) -> DataFrame:
    """One current table as a DataFrame.

    A bucketed table is read through an external catalog table named after its path, in the session's
    current database: joins and aggregations by part then need no exchange.
    """
    tables = current_tables(spark, target)
    if name not in tables:
        raise LookupError(f"{name} has not been published under {target}")
    entry = tables[name]
    if entry.get("buckets"):
        table = f"`{name}_{hashlib.sha256(entry['path'].encode()).hexdigest()[:16]}`"
        _bucketed_table(spark, name, table, entry)
        found = spark.table(table)
    else:
        # Partition columns come last in a scan; the contract's order is restored.
        found = spark.read.schema(SCHEMAS[name]).parquet(entry["path"]).select(*SCHEMAS[name].fieldNames())
    return named(found, entry["stations"]) if "stations" in entry else found


def register_snapshot(spark: SparkSession, target: str, database: str = "default") -> list[str]:
    """Make the current tables available to SQL by name.

    Plain tables become temporary views. Bucketed tables become catalog tables over the published
    files, so that joins and aggregations by part need no exchange.
    """
    names = []
    for name, entry in current_tables(spark, target).items():
        if entry.get("buckets"):
            spark.catalog.dropTempView(name)  # an older view of that name would hide the table
            full_name = f"{database}.{name}"
            if spark.catalog.tableExists(full_name):
                if spark.catalog.getTable(full_name).tableType != "EXTERNAL":
                    raise FileExistsError(f"{full_name} is a table of its own; register into another database")
                spark.sql(f"DROP TABLE `{database}`.`{name}`")
            _bucketed_table(spark, name, f"`{database}`.`{name}`", entry)
        else:
            snapshot_table(spark, target, name).createOrReplaceTempView(name)
        names.append(name)
    return names
