"""The early-stopping probe for unknown parts, and distinct counts kept as bitmaps."""

import pytest
from conftest import parts_frame, tuples, visits_frame
from pyspark.sql import functions as F

from millwright.contracts import GateError
from millwright.operators import gates
from millwright.plans import measurements as kept
from millwright.session import scratch_path


@pytest.mark.parametrize("ids", [[], [0], [-1, 1 << 62, -(1 << 63), 7], list(range(0, 60_000, 3))])
def test_the_filter_never_loses_a_known_key(spark, ids):
    parts = spark.createDataFrame([(i,) for i in ids], "part_id BIGINT")
    blocks = 3
    filled = gates.key_filter(parts.union(parts), "part_id", blocks)
    assert gates.rows_outside(parts, filled, "part_id", blocks).count() == 0
    others = spark.range(1, 60_000, 3).select(F.col("id").alias("part_id"))
    outside = gates.rows_outside(others, filled, "part_id", blocks).count()
    assert outside > 0.97 * 20_000  # few unknown keys look known
    null = spark.createDataFrame([(None,)], "part_id BIGINT")
    assert gates.rows_outside(null, filled, "part_id", blocks).count() == 1


def test_has_unknown_is_exact(spark):
    parts = spark.range(2000).select(F.col("id").alias("part_id"), F.lit(0).cast("byte").alias("response"))
    known = spark.range(0, 2000, 5).selectExpr("id AS part_id", "'L0_S0' AS station")
    assert not gates.has_unknown(known, parts)
    gates.require_known(known, parts, "orphans")
    for odd in (2000, -1, None):
        extra = spark.createDataFrame([(odd, "L0_S0")], "part_id BIGINT, station STRING")
        assert gates.has_unknown(known.union(extra), parts)
        with pytest.raises(GateError):
            gates.require_known(known.union(extra), parts, "orphans")
    assert gates.has_unknown(known, parts.limit(0)) and not gates.has_unknown(known.limit(0), parts.limit(0))


def test_an_orphan_that_the_filter_misses_is_found_all_the_same(spark, monkeypatch):
    parts = parts_frame(spark, [(i, 0) for i in range(50)])
    visits = visits_frame(spark, [(1, "a"), (50, "a")])
    monkeypatch.setattr(gates, "rows_outside", lambda rows, *_: rows.limit(0))
    assert gates.has_unknown(visits, parts)
    with pytest.raises(GateError, match="gone"):
        gates.require_known(visits, parts, "gone")


def test_more_parts_than_the_filter_holds(spark):
    parts = spark.range(100_000).select(F.col("id").alias("part_id"))
    rows = spark.range(90_000, 110_000).select(F.col("id").alias("part_id"))
    found = gates.first_unknown(rows, parts, filter_bytes=8192)
    assert found["part_id"] >= 100_000
    assert gates.first_unknown(rows.where("part_id < 100000"), parts, filter_bytes=8192) is None


def test_an_early_orphan_ends_the_probe_after_a_few_tasks(spark):
    path = scratch_path(spark, "probe")
    # The scan takes the largest file first, so the orphan is early there.
    visits = spark.range(0, 64_000, 1, 64).selectExpr(
        "IF(id = 3, -5, id) AS part_id", "'L0_S0' AS station", "explode(sequence(1, IF(id < 1000, 9, 1)))"
    )
    visits.write.parquet(path)
    parts = spark.range(64_000).select(F.col("id").alias("part_id"))
    blocks = 12
    before = {key: spark.conf.get(key) for key in ("spark.sql.files.openCostInBytes",)}
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))  # one task per file
    try:
        filled = gates.key_filter(parts, "part_id", blocks)
        stored = spark.read.parquet(path)
        assert stored.rdd.getNumPartitions() >= 64
        suspects = gates.rows_outside(stored, filled, "part_id", blocks)
        plan = suspects._jdf.queryExecution().executedPlan().toString()
        tracker = spark.sparkContext.statusTracker()
        spark.sparkContext.setJobGroup("probe", "probe")
        (found,) = suspects.take(1)
        sizes = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("probe") for s in tracker.getJobInfo(j).stageIds]
        spark.sparkContext.setJobGroup("clean", "clean")
        suspects.where("part_id <> -5").take(1)
        all_sizes = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("clean") for s in tracker.getJobInfo(j).stageIds]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for key, value in before.items():
            spark.conf.set(key, value)
    assert found["part_id"] == -5
    scanned = plan[plan.index("BroadcastHashJoin") : plan.index("BroadcastExchange")]
    assert "Exchange hashpartitioning" not in scanned and "HashAggregate" not in scanned
    assert max(sizes) <= 16 and sum(all_sizes) > sum(sizes)


def test_kept_coverage_equals_the_direct_count(spark):
    rows = [(p, s, f"{s}_F{f}", 1.0, f"{s}_D{f}", None if f == 2 else 2.0)
            for p in (-3, 0, 1, 32_767, 32_768, 70_000) for s in ("L0_S0", "L0_S1", "L3_S32") for f in range(3) if (p + f) % 2]
    long = spark.createDataFrame(
        rows, "part_id BIGINT, station STRING, feature_name STRING, measurement_value DOUBLE, date_feature_name STRING, observed_time DOUBLE"
    ).repartition(5)
    totals, bitmaps = kept.feature_totals(long), kept.measured_parts(long)
    for station in ("L0_S0", "L3_S32", "L9_S9"):
        assert tuples(kept.kept_station_coverage(totals, bitmaps, station)) == tuples(kept.station_measurement_coverage(long, station))
    by_line = kept.measurement_coverage(totals, bitmaps, F.left("station", F.lit(2)))
    want = long.groupBy(F.left("station", F.lit(2)).alias("g")).agg(
        F.count("*"), F.countDistinct("feature_name"), F.countDistinct("part_id")
    )
    assert tuples(by_line) == tuples(want)
    # Bitmaps of two loads that overlap are united, not added up.
    again = kept.measurement_coverage(totals.union(totals), bitmaps.union(bitmaps))
    assert [r["parts"] for r in again.orderBy("station").collect()] == [
        r["parts"] for r in kept.measurement_coverage(totals, bitmaps).orderBy("station").collect()
    ]
    plan = kept.measurement_coverage(totals, bitmaps)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(part_id" not in plan


def test_bitmaps_are_kept_for_close_ids_only(spark):
    close = spark.range(1000).select(F.col("id").alias("part_id"))
    assert kept.close_ids(close)
    assert not kept.close_ids(close.select((F.col("part_id") * (1 << 40)).alias("part_id")))
    assert not kept.close_ids(close.limit(0))
