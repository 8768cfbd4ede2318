import json
import os

import pytest
from conftest import tuples

from millwright.contracts import Expected, GateError
from millwright.operators.catalog import column_catalog, pairs_of
from millwright.operators.reshape import pack_times, pack_values, unfold_cells
from millwright.plans.diagnostics import ingestion_report, report_rows, require_passed
from millwright.plans.loads import load_measurements, refresh
from millwright.plans.measurements import measurement_validation, station_measurement_coverage
from millwright.sinks import current_tables, register_snapshot, snapshot_table, write_report
from millwright.sinks.publish import publish_tables
from millwright.sources import read_header, read_wide_csv

NUMERIC = "Id,L0_S0_F0,L3_S32_F2,L3_S32_F9,Response\n1,1.5,2,,0\n2,,3,4,1\n3,,,,0\n4,7,,5,1\n"
DATES = "Id,L0_S0_D1,L3_S32_D3,L3_S32_D4\n4,9,,8\n1,5,6,7\n2,,8,2\n3,,,\n"


@pytest.fixture
def sources(spark, csv_file):
    def make(numeric=NUMERIC, dates=DATES):
        make.n += 1
        paths = csv_file(f"n{make.n}.csv", numeric), csv_file(f"d{make.n}.csv", dates)
        return tuple(read_wide_csv(spark, p) for p in paths)

    make.n = 0
    return make


def test_full_refresh(spark, sources, tmp_path):
    target = str(tmp_path / "t")
    assert current_tables(spark, target) == {}
    with pytest.raises(LookupError):
        snapshot_table(spark, target, "parts")
    totals = refresh(spark, target, *sources(), expected_rows=4)
    assert totals == {"parts": 4, "failed_parts": 2, "station_visits": 5}
    assert tuples(snapshot_table(spark, target, "parts")) == [(1, 0), (2, 1), (3, 0), (4, 1)]
    visits = [(1, "L0_S0", 5.0, 5.0), (1, "L3_S32", 6.0, 7.0), (2, "L3_S32", 2.0, 8.0), (4, "L0_S0", 9.0, 9.0),
              (4, "L3_S32", 8.0, 8.0)]
    assert tuples(snapshot_table(spark, target, "station_visits")) == visits
    # Replacing is whole: no old rows stay.
    refresh(spark, target, *sources("Id,Response\n7,1\n", "Id,L0_S0_D1\n7,3\n"))
    assert tuples(snapshot_table(spark, target, "parts")) == [(7, 1)]
    assert tuples(snapshot_table(spark, target, "station_visits")) == [(7, "L0_S0", 3.0, 3.0)]


BAD_SOURCES = {
    "missing id": ("Id,Response\n1,0\n,1\n", DATES),
    "repeated id": ("Id,Response\n1,0\n1,1\n", DATES),
    "response 2": ("Id,Response\n1,0\n2,2\n", DATES),
    "response missing": ("Id,Response\n1,0\n2,\n", DATES),
    "fractional id": ("Id,Response\n1,0\n4.5,1\n", DATES),
    "unknown date id": (NUMERIC, "Id,L0_S0_D1\n1,1\n99,1\n"),
    "repeated date id": (NUMERIC, "Id,L0_S0_D1\n1,1\n1,2\n"),
    "missing date id": (NUMERIC, "Id,L0_S0_D1\n1,1\n,2\n"),
    "no parts": ("Id,Response\n", "Id,L0_S0_D1\n"),
}


@pytest.mark.parametrize("case", sorted(BAD_SOURCES))
def test_failed_refresh_keeps_the_old_snapshot(spark, sources, tmp_path, case):
    target = str(tmp_path / "t")
    refresh(spark, target, *sources())
    before, folders = current_tables(spark, target), os.listdir(f"{target}/runs")
    with pytest.raises(Exception):
        refresh(spark, target, *sources(*BAD_SOURCES[case]))
    assert current_tables(spark, target) == before
    assert os.listdir(f"{target}/runs") == folders
    assert snapshot_table(spark, target, "parts").count() == 4


def test_wrong_expected_rows(spark, sources, tmp_path):
    with pytest.raises(GateError):
        refresh(spark, str(tmp_path / "a"), *sources(), expected_rows=5)
    target = str(tmp_path / "b")
    numeric, dates = sources()
    refresh(spark, target, numeric)
    with pytest.raises(GateError):
        refresh(spark, target, dates=dates, expected_rows=3)
    # A date source has to cover all loaded parts, whether or not a row count is expected.
    _, fewer = sources(dates="Id,L0_S0_D1\n1,1\n")
    for rows in (4, None):
        with pytest.raises(GateError):
            refresh(spark, target, dates=fewer, expected_rows=rows)


def test_a_publication_that_someone_else_overtook_fails(spark, sources, tmp_path):
    target = str(tmp_path / "t")
    refresh(spark, target, *sources())
    seen = current_tables(spark, target)
    refresh(spark, target, sources()[0])
    with pytest.raises(RuntimeError):
        publish_tables(spark, target, seen, seen)
    assert current_tables(spark, target) != seen


def test_no_scratch_is_left_by_a_failed_measurement_load(spark, sources, tmp_path):
    target = str(tmp_path / "t")
    with pytest.raises(GateError):
        load_measurements(spark, target, *sources(), expected_rows=5)
    assert os.listdir(f"{target}/runs") == []


def test_measurements_are_published_beside_the_other_tables(spark, sources, tmp_path):
    target = str(tmp_path / "t")
    refresh(spark, target, *sources())
    totals = load_measurements(spark, target, *sources(), expected_pairs=2)
    assert snapshot_table(spark, target, "mapped_measurements").count() == totals["measurements"]
    assert current_tables(spark, target)["mapped_measurements"]["rows"] == totals["measurements"]
    kept = {"feature_totals", "measured_parts", "station_sets"}
    session = spark.newSession()
    session.sql("CREATE DATABASE beside")
    assert set(register_snapshot(session, target, "beside")) == {"parts", "station_visits", "mapped_measurements", *kept}
    session.sql("DROP DATABASE beside CASCADE")


def test_separate_refreshes(spark, sources, tmp_path):
    target = str(tmp_path / "t")
    numeric, dates = sources()
    with pytest.raises(GateError):
        refresh(spark, target, dates=dates)
    with pytest.raises(GateError):
        refresh(spark, target)
    assert refresh(spark, target, numeric) == {"parts": 4, "failed_parts": 2}
    assert refresh(spark, target, dates=dates) == {"station_visits": 5}
    # New parts must still cover the current visits.
    smaller, _ = sources("Id,Response\n1,0\n2,1\n")
    with pytest.raises(GateError):
        refresh(spark, target, smaller)
    assert snapshot_table(spark, target, "parts").count() == 4
    larger, _ = sources("Id,Response\n1,0\n2,1\n3,0\n4,0\n5,0\n")
    assert refresh(spark, target, larger)["parts"] == 5
    assert snapshot_table(spark, target, "station_visits").count() == 5


def test_bucketed_snapshot_joins_without_exchange(spark, sources, tmp_path):
    from millwright.plans.metrics import production_paths, station_exposure

    target = str(tmp_path / "t")
    refresh(spark, target, *sources(), buckets=4)
    spark.range(3).createOrReplaceTempView("parts")
    for _ in range(2):  # registering again replaces the entry
        assert sorted(register_snapshot(spark, target)) == ["parts", "station_sets", "station_visits"]
    parts, visits = spark.table("parts"), spark.table("station_visits")
    assert parts.count() == 4 and visits.count() == 5
    plain = refresh(spark, str(tmp_path / "p"), *sources())
    assert plain["station_visits"] == 5
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for report in (station_exposure(parts, visits), production_paths(parts, visits)):
            plan = report._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning(part_id" not in plan
        unbucketed = [snapshot_table(spark, str(tmp_path / "p"), n) for n in ("parts", "station_visits")]
        assert tuples(station_exposure(parts, visits)) == tuples(station_exposure(*unbucketed))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        spark.sql("DROP TABLE parts")
        spark.sql("DROP TABLE station_visits")
        spark.sql("DROP TABLE station_sets")


def test_registering_never_drops_a_managed_table(spark, sources, tmp_path):
    target = str(tmp_path / "t")
    refresh(spark, target, *sources(), buckets=2)
    spark.range(7).write.saveAsTable("parts")
    try:
        with pytest.raises(FileExistsError):
            register_snapshot(spark, target)
        assert spark.table("parts").count() == 7
    finally:
        spark.sql("DROP TABLE parts")


def test_measurement_load(spark, sources, tmp_path):
    target = str(tmp_path / "t")
    totals = load_measurements(spark, target, *sources(), expected_pairs=2, expected_rows=4)
    assert totals == {"pairs": 2, "parts": 4, "measurements": 4, "missing_times": 0}
    rows = [
        (1, "L0_S0", "L0_S0_F0", 1.5, "L0_S0_D1", 5.0),
        (1, "L3_S32", "L3_S32_F2", 2.0, "L3_S32_D3", 6.0),
        (2, "L3_S32", "L3_S32_F2", 3.0, "L3_S32_D3", 8.0),
        (4, "L0_S0", "L0_S0_F0", 7.0, "L0_S0_D1", 9.0),
    ]
    assert tuples(spark.table("mapped_measurements")) == rows
    stored = snapshot_table(spark, target, "mapped_measurements")
    assert tuples(stored) == rows
    assert tuple(measurement_validation(stored).first()) == (4, 2, 0)
    coverage = station_measurement_coverage(stored)
    assert tuples(coverage) == [("L3_S32", 2, 1, 2)]
    plan = coverage._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(station" in plan and "L3_S32" in plan
    assert station_measurement_coverage(stored, "L9_S9").collect() == []
    with pytest.raises(FileExistsError):
        load_measurements(spark, target, *sources())
    assert tuples(snapshot_table(spark, target, "mapped_measurements")) == rows


def test_measurement_load_gates(spark, sources, tmp_path):
    with pytest.raises(GateError):
        load_measurements(spark, str(tmp_path / "a"), *sources(), expected_pairs=3)
    with pytest.raises(GateError):
        load_measurements(spark, str(tmp_path / "b"), *sources(), expected_rows=5)
    with pytest.raises(GateError):
        load_measurements(spark, str(tmp_path / "c"), *sources(dates="Id,L0_S0_D1\n1,1\n"))
    with pytest.raises(GateError):
        load_measurements(spark, str(tmp_path / "d"), *sources(numeric="Id,L0_S0_F0,Response\n1,,0\n2,,0\n3,,0\n4,,0\n"))
    # Nothing is left of a failed load, and the next one succeeds.
    assert all(os.listdir(tmp_path / name / "runs") == [] for name in "bcd")
    assert load_measurements(spark, str(tmp_path / "d"), *sources())["measurements"] == 4


def test_ingestion_report(spark, sources, tmp_path, csv_file):
    target = str(tmp_path / "t")
    refresh(spark, target, *sources())
    totals = load_measurements(spark, target, *sources())
    catalogs = [
        column_catalog(spark, read_header(spark, csv_file(f"h{i}.csv", text))) for i, text in enumerate((NUMERIC, DATES))
    ]
    tables = (
        snapshot_table(spark, target, "parts"),
        snapshot_table(spark, target, "station_visits"),
        snapshot_table(spark, target, "mapped_measurements"),
    )
    right = Expected(4, 2, 2, 2, 0, 5, 4)
    report = ingestion_report(*tables, *catalogs, expected=right, counted_measurements=totals["measurements"])
    write_report(report, str(tmp_path / "report"))
    (name,) = [f for f in os.listdir(tmp_path / "report") if f.endswith(".json")]
    document = json.loads((tmp_path / "report" / name).read_text())
    for counted in (None, totals["measurements"] + 1):
        wrong = ingestion_report(*tables, *catalogs, expected=right, counted_measurements=counted).first()
        assert wrong["status"] == "failed"
        assert [k for k, ok in wrong["checks"].items() if not ok] == ["measurement_count_matches_parquet"]
    assert document["status"] == "passed" and set(document["checks"].values()) == {True}
    assert len(document["checks"]) == 8
    assert document["created_utc"].endswith("+00:00")
    assert document["loaded"] == {
        "parts": 4, "failed_parts": 2, "station_observations": 5, "distinct_stations": 2,
        "mapped_measurements": 4, "mapped_features": 2, "missing_matched_times": 0,
    }
    assert document["source"]["numeric_columns"] == 5 and document["source"]["date_columns"] == 4
    # L3_S32_F9 has no time column; every mapped feature counts as timed, whether it has values or not.
    assert document["coverage_note"].startswith("2 numeric features") and "; 1 other feature" in document["coverage_note"]
    require_passed(report)
    wrong = ingestion_report(*tables, *catalogs, expected=Expected(), clock=False)
    assert wrong.first()["status"] == "failed"
    assert report_rows(wrong).where("section = 'checks'").count() == 8
    with pytest.raises(GateError, match="date_header_shape"):
        require_passed(wrong)


def moved_bytes(plan) -> int:
    """Bytes of all rows that the exchanges of a finished plan have moved, before compression."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return moved_bytes(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return moved_bytes(plan.plan())
    own = plan.metrics().apply("dataSize").value() if kind == "ShuffleExchangeExec" else 0
    return own + sum(moved_bytes(plan.children().apply(i)) for i in range(plan.children().size()))


def test_the_merge_of_a_load_moves_filled_cells_only(spark):
    """One filled cell in 300: whole rows would be 5 KB a part on both sides together."""
    at = [f"IF(id % 300 = {i}, CAST(id AS DOUBLE), NULL) AS `L0_S{i}" for i in range(300)]
    numeric = spark.range(3000).selectExpr("id AS Id", *[f"{cell}_F2`" for cell in at], "0 AS Response")
    dates = spark.range(3000).selectExpr("id AS Id", *[f"{cell}_D3`" for cell in at])
    pairs = pairs_of(numeric, dates)
    cells = unfold_cells(pack_values(numeric, pairs), pack_times(dates, pairs), pairs)
    assert tuples(cells, "part_id", "i", "observed_time") == [(p, p % 300, float(p)) for p in range(3000)]
    collected = cells.select("part_id", "measurement_value", "observed_time")
    collected.collect()
    moved = moved_bytes(collected._jdf.queryExecution().executedPlan())
    assert 0 < moved < 3000 * 400
