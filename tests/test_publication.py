"""Publication that survives a publisher killed at any step, and layouts that follow from measured bytes."""

import json
import os
import time

import pytest
from conftest import tuples

from millwright.plans import loads
from millwright.contracts import VISIT_ORDER
from millwright.plans.investigate import target_vs_line
from millwright.plans.metrics import production_paths, station_exposure
from millwright.sinks import LeaseHeld, current_tables, ready_runs, resume_publication, snapshot_table, write_counted
from millwright.sinks import publish
from millwright.sources import read_wide_csv

NUMERIC = "Id,L0_S0_F0,L3_S32_F2,Response\n1,1.5,2,0\n2,,3,1\n3,,,0\n"
DATES = "Id,L0_S0_D1,L3_S32_D3\n3,9,\n1,5,6\n2,,8\n"


class Killed(BaseException):
    """Ends the publisher where it stands: nothing of its own cleaning up is meant to run."""


@pytest.fixture
def wide(spark, csv_file):
    return [read_wide_csv(spark, csv_file(name, text)) for name, text in (("n.csv", NUMERIC), ("d.csv", DATES))]


def leave_lease(target, text, age=0.0):
    path = os.path.join(target, "_CURRENT.lease")
    checksum = os.path.join(target, "._CURRENT.lease.crc")
    if os.path.exists(checksum):
        os.remove(checksum)
    with open(path, "w") as out:
        out.write(text)
    os.utime(path, (time.time() - age,) * 2)


def lease(ends):
    return json.dumps({"owner": "a publisher that died", "ends": ends})


def test_a_held_lease_keeps_others_out_and_an_ended_one_does_not(spark, wide, tmp_path):
    target = str(tmp_path / "t")
    loads.refresh(spark, target, *wide)
    before = current_tables(spark, target)
    leave_lease(target, lease(time.time() + 60))
    with pytest.raises(LeaseHeld, match="a publisher that died"):
        loads.refresh(spark, target, *wide)
    assert current_tables(spark, target) == before
    # What was staged meanwhile is ready and needs no second load.
    (run,) = ready_runs(spark, target)
    leave_lease(target, lease(time.time() - 1))
    resume_publication(spark, target, run)
    now = current_tables(spark, target)
    assert now != before and all(run in entry["path"] for entry in now.values())
    assert tuples(snapshot_table(spark, target, "parts")) == [(1, 0), (2, 1), (3, 0)]
    assert ready_runs(spark, target) == []
    assert not [name for name in os.listdir(target) if "lease" in name]


ONE, TWO, THREE = ({"parts": {"path": f"runs/{i}/parts", "buckets": 1, "rows": i}} for i in range(3))


@pytest.mark.parametrize("text,age,free", [("", 0, False), ("", 1000, True), ('{"own', 1000, True), (None, 0, True)])
def test_a_lease_cut_short_ends_too(spark, tmp_path, text, age, free):
    target = str(tmp_path)
    publish.publish_tables(spark, target, ONE, {})
    if text is not None:
        leave_lease(target, text, age)
    if free:
        publish.publish_tables(spark, target, TWO, ONE)
    else:
        with pytest.raises(LeaseHeld):
            publish.publish_tables(spark, target, TWO, ONE)
    assert current_tables(spark, target) == (TWO if free else ONE)


@pytest.mark.parametrize("step", ["_take_lease", "_write_json", "_replace_pointer", "current_tables", "remove_path"])
@pytest.mark.parametrize("after", [False, True])
def test_a_publisher_killed_at_any_step(spark, tmp_path, monkeypatch, step, after):
    """Dies before or after the step, leaves its lease behind, and the next publisher succeeds."""
    target = str(tmp_path)
    publish.publish_tables(spark, target, ONE, {})
    real = getattr(publish, step)

    def dying(*args, **kwargs):
        if after:
            real(*args, **kwargs)
        raise Killed

    with monkeypatch.context() as patched:
        patched.setattr(publish, "remove_path", lambda *a: None)  # a dead publisher cannot release its lease
        patched.setattr(publish, step, dying)
        with pytest.raises(Killed):
            publish.publish_tables(spark, target, TWO, ONE)
    if os.path.exists(os.path.join(target, "_CURRENT.lease")):
        with pytest.raises(LeaseHeld):
            publish.publish_tables(spark, target, THREE, current_tables(spark, target))
        leave_lease(target, lease(time.time() - 1))
    now = current_tables(spark, target)
    assert now == (TWO if step == "remove_path" or (step, after) == ("_replace_pointer", True) else ONE)
    publish.publish_tables(spark, target, THREE, now)
    assert current_tables(spark, target) == THREE


def test_a_load_killed_before_its_publication_is_taken_up_again(spark, wide, tmp_path, monkeypatch):
    target = str(tmp_path / "t")
    with monkeypatch.context() as patched:
        patched.setattr(loads, "publish_tables", lambda *a: (_ for _ in ()).throw(Killed))
        with pytest.raises(Killed):
            loads.refresh(spark, target, *wide)
    assert current_tables(spark, target) == {}
    with pytest.raises(LookupError):
        resume_publication(spark, target, "unknown")
    (run,) = ready_runs(spark, target)
    resume_publication(spark, target, run)
    resume_publication(spark, target, run)  # nothing is left to do
    visits = snapshot_table(spark, target, "station_visits")
    assert tuples(visits, "part_id", "station") == [(1, "L0_S0"), (1, "L3_S32"), (2, "L3_S32"), (3, "L0_S0")]


def test_the_holder_of_an_ended_lease_does_not_publish(spark, tmp_path):
    publish.publish_tables(spark, str(tmp_path), ONE, {})
    with pytest.raises(LeaseHeld):
        publish.publish_tables(spark, str(tmp_path), {}, ONE, lease_seconds=0)
    assert current_tables(spark, str(tmp_path)) == ONE


def test_an_overtaken_measurement_load_can_be_repeated(spark, wide, tmp_path, monkeypatch):
    target = str(tmp_path / "t")
    real = loads.publish_tables

    def overtaken(session, folder, tables, seen):
        with monkeypatch.context() as patched:
            patched.setattr(loads, "publish_tables", real)
            loads.refresh(spark, target, *wide)
        real(session, folder, tables, seen)

    with monkeypatch.context() as patched:
        patched.setattr(loads, "publish_tables", overtaken)
        with pytest.raises(RuntimeError, match="someone else"):
            loads.load_measurements(spark, target, *wide)
    assert loads.load_measurements(spark, target, *wide, expected_pairs=2)["measurements"] == 3
    with pytest.raises(FileExistsError):
        loads.load_measurements(spark, target, *wide)
    assert snapshot_table(spark, target, "mapped_measurements").count() == 3


def test_the_default_layout_joins_without_an_exchange(spark, wide, tmp_path):
    target = str(tmp_path / "t")
    loads.refresh(spark, target, *wide)
    tables = current_tables(spark, target)
    assert tables["parts"]["buckets"] == tables["station_visits"]["buckets"] >= 1
    parts, visits = (snapshot_table(spark, target, name) for name in ("parts", "station_visits"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for report in (station_exposure(parts, visits), production_paths(parts, visits)):
            assert "hashpartitioning(part_id" not in report._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_buckets_follow_the_stored_bytes(spark, tmp_path):
    data = tmp_path / "stored"
    data.mkdir()
    (data / "a").write_bytes(b"x" * 1000)
    assert loads.measured_buckets(spark, str(data)) == 1
    (data / "b").write_bytes(b"x" * (3 << 20))
    assert loads.measured_buckets(spark, str(data)) == 4
    with open(data / "c", "wb") as out:
        out.truncate(5 << 30)
    assert loads.measured_buckets(spark, str(data)) == 41


def test_tasks_that_merge_follow_the_stored_bytes(spark, tmp_path):
    paths = [tmp_path / name for name in ("values", "times")]
    for path in paths:
        path.mkdir()
        (path / "a").write_bytes(b"x" * 1000)
    assert loads.merge_tasks(spark, *map(str, paths)) == 1
    for path in paths:
        with open(path / "b", "wb") as out:
            out.truncate(1 << 30)
    assert loads.merge_tasks(spark, *map(str, paths)) == 513


def test_no_bucket_holds_more_visits_than_a_task_sorts(spark, wide, tmp_path, monkeypatch):
    target = str(tmp_path / "few")
    totals = loads.refresh(spark, target, *wide)
    visits = tuples(snapshot_table(spark, target, "station_visits"))
    monkeypatch.setattr(loads, "BUCKET_VISITS", 1)
    target = str(tmp_path / "many")
    assert loads.refresh(spark, target, *wide) == totals
    assert {entry["buckets"] for entry in current_tables(spark, target).values()} == {totals["station_visits"]}
    assert totals["station_visits"] > 1 and tuples(snapshot_table(spark, target, "station_visits")) == visits


def test_a_bucket_is_sorted_once(spark, tmp_path, monkeypatch):
    """By the writer alone, which always sorts: a sort before it would hold the rows a second time."""
    rows = spark.range(1000).selectExpr("id % 100 AS part_id", "concat('S', id % 7) AS station")
    monkeypatch.delattr(type(rows), "sortWithinPartitions")
    written = write_counted(rows, str(tmp_path / "t"), (), "part_id", 3, sort_by=["station", "part_id"])
    assert written.counters["rows"] == 1000
    files = list((tmp_path / "t").glob("*.parquet"))
    assert len(files) == 3
    for file in files:
        found = [(r.station, r.part_id) for r in spark.read.parquet(str(file)).collect()]
        assert found == sorted(found)


def test_tables_loaded_apart_end_in_one_layout(spark, wide, tmp_path, monkeypatch):
    target = str(tmp_path / "t")
    loads.refresh(spark, target, wide[0])
    monkeypatch.setattr(loads, "measured_buckets", lambda *_: 5)
    loads.refresh(spark, target, dates=wide[1])
    assert {entry["buckets"] for entry in current_tables(spark, target).values()} == {5}
    monkeypatch.setattr(loads, "measured_buckets", lambda *_: 9)
    loads.refresh(spark, target, wide[0])  # keeps to the visits
    assert {entry["buckets"] for entry in current_tables(spark, target).values()} == {5}
    assert tuples(snapshot_table(spark, target, "parts")) == [(1, 0), (2, 1), (3, 0)]
    loads.refresh(spark, target, *wide, buckets=None)
    assert {entry["buckets"] for entry in current_tables(spark, target).values()} == {None}


def rows_scanned(report) -> int:
    """Rows that the scan of the visits handed on, after the pushed filter skipped pages."""
    report.collect()
    plan = report._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if plan.getClass().getSimpleName().startswith("Adaptive") else plan
    found, waiting = [], [plan]
    while waiting:
        node = waiting.pop()
        if node.getClass().getSimpleName().endswith("StageExec"):
            waiting.append(node.plan())
        if node.getClass().getSimpleName() == "FileSourceScanExec" and "station" in node.output().toString():
            found.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        waiting += [children.apply(i) for i in range(children.size())]
    return sum(found)


def test_a_line_report_skips_the_pages_of_other_lines(spark, tmp_path):
    target, rows = str(tmp_path / "t"), 120_000
    parts = spark.range(rows).selectExpr("id AS part_id", "CAST(id % 7 = 0 AS TINYINT) AS response")
    visits = spark.range(rows).selectExpr(
        "id AS part_id", "concat('L', id % 4, '_S', id % 40) AS station", "1D AS first_observed_time", "2D AS last_observed_time"
    )
    written = {
        "parts": write_counted(parts, f"{target}/p", (), "part_id", 1),
        "station_visits": write_counted(visits, f"{target}/v", (), "part_id", 1, sort_by=VISIT_ORDER),
    }
    publish.publish_tables(spark, target, {name: publish.entry_of(table) for name, table in written.items()}, {})
    tables = [snapshot_table(spark, target, name) for name in ("parts", "station_visits")]
    assert 30_000 <= rows_scanned(target_vs_line(*tables, line="L3", station="L3_S3")) < 80_000
    assert rows_scanned(production_paths(*tables)) == rows
    stored = [spark.read.parquet(f"{target}/{name}") for name in ("p", "v")]
    assert tuples(target_vs_line(*tables)) == tuples(target_vs_line(*stored))
