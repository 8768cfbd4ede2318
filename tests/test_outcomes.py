"""Metrics and investigations on hand-made and random tables."""

import random

import pytest
from conftest import parts_frame, tuples, visits_frame
from pyspark.sql import functions as F

from millwright.contracts import NO_VISITS
from millwright.operators.routes import part_routes, route_flags
from millwright.plans.investigate import target_vs_line, target_within_cohort, target_within_line_group
from millwright.plans.metrics import (
    overall_quality,
    paths_by_volume,
    production_paths,
    station_exposure,
    station_table,
    top_stations,
)


def test_empty_tables(spark):
    parts, visits = parts_frame(spark, []), visits_frame(spark, [])
    assert [tuple(r) for r in overall_quality(parts).collect()] == [(0, None, None)]
    for report in (
        station_exposure(parts, visits),
        production_paths(parts, visits),
        target_vs_line(parts, visits),
        target_within_line_group(parts, visits),
        target_within_cohort(parts, visits),
    ):
        assert report.collect() == []


def test_no_failures_leaves_the_relative_rate_empty(spark):
    parts, visits = parts_frame(spark, [(1, 0), (2, 0)]), visits_frame(spark, [(1, "L0_S0"), (2, "L0_S0")])
    row = station_exposure(parts, visits).first()
    assert (row["failure_rate"], row["overall_failure_rate"], row["rate_vs_overall"]) == (0.0, 0.0, None)


def test_rates_keep_all_digits(spark):
    parts = parts_frame(spark, [(i, int(i == 0)) for i in range(3)])
    assert overall_quality(parts).first()["failure_rate"] == 1 / 3
    visits = visits_frame(spark, [(i, "L3_S1") for i in range(3)])
    assert station_exposure(parts, visits).first()["failure_rate"] == 1 / 3
    assert target_vs_line(parts, visits).first()["failure_pct"] == 33.333


def test_review_status_edges(spark):
    sizes = {"L0_S1": (1000, 20), "L0_S2": (999, 20), "L0_S3": (1000, 19)}
    parts = spark.range(1000).selectExpr("id AS part_id", "CAST(id < 20 AS TINYINT) AS response")
    visits = None
    for station, (total, failed) in sizes.items():
        rows = parts.where((F.col("response") == 0) | (F.col("part_id") < failed))
        if total - failed > 980:
            rows = rows.unionAll(spark.createDataFrame([(5000, 0)], "part_id BIGINT, response TINYINT"))
        rows = rows.orderBy("part_id").limit(total).withColumn("station", F.lit(station))
        rows = rows.selectExpr("part_id", "station", "1D AS first_observed_time", "2D AS last_observed_time")
        visits = rows if visits is None else visits.unionAll(rows)
    parts = parts.unionAll(spark.createDataFrame([(5000, 0)], "part_id BIGINT, response TINYINT"))
    got = {r["station"]: (r["parts_observed"], r["failed_parts"], r["review_status"]) for r in
           station_exposure(parts, visits).collect()}
    assert got == {
        "L0_S1": (1000, 20, "sufficient_for_initial_review"),
        "L0_S2": (999, 20, "limited_sample"),
        "L0_S3": (1000, 19, "limited_sample"),
    }


def test_odd_stations_in_paths(spark):
    parts = parts_frame(spark, [(i, 0) for i in range(1, 8)])
    visits = visits_frame(
        spark,
        [(1, "L4_S1"), (2, "L30_S1"), (3, "L3XS1"), (4, "l3_S1"), (5, "foo"), (6, "L0_S1"), (6, "L3_S2"), (99, "L1_S1")],
    )
    got = dict(tuples(production_paths(parts, visits), "line_group", "parts"))
    assert got == {NO_VISITS: 5, "L3": 1, "L0 L3": 1}


def test_paths_accept_stored_routes(spark):
    parts = parts_frame(spark, [(1, 1), (2, 0), (3, 0)])
    visits = visits_frame(spark, [(1, "L0_S1"), (2, "L1_S1"), (2, "L3_S32")])
    routes = part_routes(visits)
    assert tuples(production_paths(parts, visits, routes=routes)) == tuples(production_paths(parts, visits))
    for report in (target_vs_line, target_within_line_group, target_within_cohort):
        assert tuples(report(parts, None, routes=routes)) == tuples(report(parts, visits)) != []


def test_stored_routes_keep_their_parameters(spark, tmp_path):
    parts = parts_frame(spark, [(1, 1), (2, 0)])
    visits = visits_frame(spark, [(1, "L0_S1"), (2, "L1_S1"), (2, "L3_S32")])
    part_routes(visits).write.parquet(str(tmp_path / "routes"))
    stored = spark.read.parquet(str(tmp_path / "routes"))
    assert tuples(target_vs_line(parts, None, routes=stored)) == tuples(target_vs_line(parts, visits)) != []
    for wrong in ({"station": "L3_S33"}, {"line": "L1"}, {"lines": ("L3", "L0")}):
        for report in (target_vs_line, target_within_line_group, target_within_cohort):
            with pytest.raises(ValueError, match="were made with"):
                report(parts, None, routes=stored, **wrong)
    with pytest.raises(ValueError, match="were made with"):
        production_paths(parts, None, lines=("L3", "L0"), routes=stored)
    with pytest.raises(ValueError, match="unknown"):
        production_paths(parts, None, routes=parts.selectExpr("part_id", "1L AS line_mask"))


def test_more_lines_than_one_mask_holds(spark):
    lines = [f"L{i}" for i in range(100)]
    parts = parts_frame(spark, [(1, 1), (2, 0), (3, 0), (4, 0)])
    visits = visits_frame(spark, [(1, "L0_S1"), (1, "L99_S7"), (2, "L61_S1"), (2, "L62_S1"), (2, "L99_S8")])
    assert tuples(production_paths(parts, visits, lines)) == [
        ("L0 L99", 1, 1, 100.0), ("L61 L62 L99", 1, 0, 0.0), (NO_VISITS, 2, 0, 0.0),
    ]
    flags = route_flags(part_routes(visits, lines, "L99", "L99_S7"), lines).orderBy("part_id").collect()
    assert [[c for c in ("l0", "l61", "l62", "l99", "visited_target") if row[c]] for row in flags] == [
        ["l0", "l99", "visited_target"], ["l61", "l62", "l99"],
    ]
    got = target_within_line_group(parts, visits, "L99", "L99_S7", lines, ("yes", "no"))
    assert tuples(got) == [("L0 L99", "yes", 1, 1, 100.0), ("L61 L62 L99", "no", 1, 0, 0.0)]
    assert len(target_within_cohort(parts, visits, "L99", "L99_S7", 2, lines).collect()) == 2


def test_comparison_sorted_by_rate(spark):
    parts = parts_frame(spark, [(1, 0), (2, 1)])
    visits = visits_frame(spark, [(1, "L3_S32"), (2, "L3_S1")])
    by_label = [r["part_group"] for r in target_vs_line(parts, visits).collect()]
    by_rate = [r["part_group"] for r in target_vs_line(parts, visits, by_rate=True).collect()]
    assert by_label == ["L3_S32 observed", "Other L3 parts"] == by_rate[::-1]


def test_duplicate_visits_do_not_fan_out(spark):
    parts = parts_frame(spark, [(1, 1), (2, 0)])
    visits = visits_frame(spark, [(1, "L3_S32")] * 3 + [(2, "L3_S1")] * 2)
    assert tuples(target_vs_line(parts, visits)) == [
        ("L3_S32 observed", 1, 1, 100.0),
        ("Other L3 parts", 1, 0, 0.0),
    ]


def test_ties_are_broken_by_name(spark):
    parts = parts_frame(spark, [(i, i % 2) for i in range(4)])
    visits = visits_frame(spark, [(i, s) for i in range(4) for s in ("L0_S9", "L0_S1", "L1_S5")])
    table = station_table(station_exposure(parts, visits), min_parts=4)
    assert [r["station"] for r in table.collect()] == ["L0_S1", "L0_S9", "L1_S5"]
    assert [r["station"] for r in top_stations(parts, visits, min_parts=1, k=2).collect()] == ["L0_S1", "L0_S9"]
    assert top_stations(parts, visits).collect() == []
    two = parts_frame(spark, [(1, 0), (2, 0)]), visits_frame(spark, [(1, "L1_S1"), (2, "L0_S1")])
    paths = paths_by_volume(production_paths(*two))
    assert [r["line_group"] for r in paths.collect()] == ["L0", "L1"]


@pytest.fixture(scope="module")
def random_tables(spark):
    rng = random.Random(11)
    stations = ["L0_S1", "L0_S7", "L1_S24", "L2_S26", "L3_S29", "L3_S32", "L3_S33", "L4_S1"]
    parts = [(i, int(rng.random() < 0.2)) for i in range(400) if i % 37]
    visits = [
        (i, s, t, t + rng.randint(0, 3))
        for i in range(400)
        for s in stations
        if rng.random() < 0.3
        for t in [float(rng.randint(0, 9))]
    ]
    visits += [(1000, "L3_S32", None, None), (1, "L3_S40", None, 1.0)]
    return parts, visits


def by_part(visits):
    out = {}
    for row in visits:
        out.setdefault(row[0], []).append(row)
    return out


def summary(groups):
    return sorted(
        (*key, len(v), sum(v), round(100.0 * sum(v) / len(v), 3)) for key, v in groups.items()
    )


def test_target_reports_against_brute_force(spark, random_tables):
    part_rows, visit_rows = random_tables
    response, seen = dict(part_rows), by_part(visit_rows)
    parts = parts_frame(spark, part_rows).repartition(3)
    visits = visits_frame(spark, visit_rows).repartition(7)

    vs, groups, paths = {}, {}, {}
    for part, answer in response.items():
        rows = seen.get(part, [])
        lines = [line for line in ("L0", "L1", "L2", "L3") if any(r[1].startswith(line + "_S") for r in rows)]
        paths.setdefault((" ".join(lines) or NO_VISITS,), []).append(answer)
        if "L3" in lines:
            target = any(r[1] == "L3_S32" for r in rows)
            vs.setdefault(("L3_S32 observed" if target else "Other L3 parts",), []).append(answer)
            label = "L3_S32 observed" if target else "L3_S32 not observed"
            groups.setdefault((" ".join(lines), label), []).append(answer)
    assert tuples(target_vs_line(parts, visits)) == summary(vs)
    assert tuples(target_within_line_group(parts, visits)) == summary(groups)
    assert tuples(production_paths(parts, visits)) == summary(paths)

    timed = []
    for part, rows in seen.items():
        times = [r[2] for r in rows if r[1].startswith("L3_S") and r[2] is not None]
        if times:
            timed.append((min(times), part, any(r[1] == "L3_S32" for r in rows)))
    timed.sort()
    size, extra, cohorts, at = len(timed) // 10, len(timed) % 10, {}, 0
    for tile in range(1, 11):
        step = size + (tile <= extra)
        for _, part, target in timed[at : at + step]:
            if part in response:
                label = "S32 observed" if target else "S32 not observed"
                cohorts.setdefault((tile, label), []).append(response[part])
        at += step
    assert tuples(target_within_cohort(parts, visits)) == summary(cohorts)


def test_partitioning_and_order_change_nothing(spark, random_tables):
    part_rows, visit_rows = random_tables
    reports = (station_exposure, production_paths, target_vs_line, target_within_line_group, target_within_cohort)
    first = [tuples(r(parts_frame(spark, part_rows), visits_frame(spark, visit_rows))) for r in reports]
    shuffled = visit_rows[:]
    random.Random(3).shuffle(shuffled)
    again = [
        tuples(r(parts_frame(spark, part_rows[::-1]).repartition(1), visits_frame(spark, shuffled).repartition(13)))
        for r in reports
    ]
    assert first == again


def test_parameters_and_labels(spark, random_tables):
    part_rows, visit_rows = random_tables
    parts, visits = parts_frame(spark, part_rows), visits_frame(spark, visit_rows)
    other = target_vs_line(parts, visits, line="L0", station="L0_S7")
    assert [r["part_group"] for r in other.collect()] == ["L0_S7 observed", "Other L0 parts"]
    labelled = target_within_line_group(parts, visits, labels=("S32 observed", "S32 not observed"))
    assert {r["s32_group"] for r in labelled.collect()} == {"S32 observed", "S32 not observed"}
    assert {r["time_cohort"] for r in target_within_cohort(parts, visits, tiles=3).collect()} == {1, 2, 3}


def test_sums_agree_between_reports(spark, random_tables):
    part_rows, visit_rows = random_tables
    parts, visits = parts_frame(spark, part_rows), visits_frame(spark, visit_rows)
    total = lambda df: df.agg(F.sum("parts")).first()[0]
    assert total(production_paths(parts, visits)) == len(part_rows)
    assert total(target_vs_line(parts, visits)) == total(target_within_line_group(parts, visits))


def test_route_flags(spark):
    visits = visits_frame(spark, [(1, "L0_S1"), (1, "L3_S32", 4.0, 5.0), (1, "L3_S33", 2.0, 9.0), (2, "L1_S2")])
    assert tuples(route_flags(part_routes(visits))) == [(1, 1, 0, 0, 1, 1, 2.0), (2, 0, 1, 0, 0, 0, None)]
