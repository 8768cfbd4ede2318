"""Plans that must hold at scale, and whole-table answers when a third of the rows share a key."""

import duckdb
import pytest

from compare import TABLES, differences, oracle_connection
from conftest import parts_frame, visits_frame
from pyspark.sql import functions as F

from millwright.plans.investigate import target_vs_line
from millwright.plans.metrics import production_paths, station_exposure
from millwright.session import scratch_path
from millwright.sources import read_parts, read_visits
from workload import oracles, queries as registry


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark):
    base = scratch_path(spark, "plans")
    parts_frame(spark, [(i, i % 2) for i in range(50)]).write.parquet(f"{base}/parts")
    visits_frame(spark, [(i, s) for i in range(50) for s in ("L0_S1", "L3_S32")]).write.parquet(f"{base}/visits")
    return read_parts(spark, f"{base}/parts"), read_visits(spark, f"{base}/visits")


def test_line_filter_reaches_the_scan(stored):
    plan = plan_of(target_vs_line(*stored))
    assert "StringStartsWith(station,L3)" in plan
    assert "ReadSchema: struct<part_id:bigint,station:string>" in plan


def test_visits_are_reduced_before_they_move(stored):
    plan = plan_of(production_paths(*stored))
    exchange = plan.index("hashpartitioning(part_id")
    assert "partial_bit_or" in plan[exchange:]
    assert plan.count("Exchange hashpartitioning(part_id") <= 2


def test_overall_rate_is_a_scalar_subquery(stored):
    plan = plan_of(station_exposure(*stored))
    assert "Subquery" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("name", sorted(registry.registered()))
def test_no_query_pairs_everything(spark, sf_dir, name):
    plan = plan_of(registry.registered()[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.fixture(scope="module")
def skewed_dir(sf_dir, tmp_path_factory):
    """The given tables with a third of the line items on one order and a third on one station."""
    folder = tmp_path_factory.mktemp("skewed")
    con = duckdb.connect()
    for name in TABLES:
        columns = "*"
        if name == "lineitem":
            columns = (
                "* REPLACE (CASE WHEN l_orderkey % 3 = 0 THEN 11 ELSE l_orderkey END AS l_orderkey, "
                "CASE WHEN l_partkey % 3 = 1 THEN 32 + 61 * (l_partkey % 5) ELSE l_partkey END AS l_partkey)"
            )
        con.execute(
            f"COPY (SELECT {columns} FROM read_parquet('{sf_dir}/{name}.parquet')) TO '{folder}/{name}.parquet'"
        )
    return str(folder)


@pytest.mark.parametrize("name", sorted(registry.registered()))
def test_hot_keys(spark, skewed_dir, name):
    found = differences(registry.registered()[name](spark, skewed_dir), oracle_connection(skewed_dir), oracles.oracle_sql()[name])
    assert found in (None, "no rows on either side")


def test_a_hot_part_in_ungated_visits_is_split(spark):
    """A third of the visits on one part: the raw join is split at run time, and nothing is lost."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {key: spark.conf.get(key) for key in settings}
    rows = 90_000
    parts = spark.range(rows).selectExpr("id AS part_id", "CAST(id % 10 = 0 AS TINYINT) AS response")
    visits = spark.range(rows).repartition(16).selectExpr(
        "IF(id % 3 = 0, 7, id) AS part_id",
        "concat('L0_S', uuid()) AS station",
        "1D AS first_observed_time",
        "2D AS last_observed_time",
    ).withColumn("station", F.expr("IF(length(station) > 0, concat('L0_S', pmod(hash(station), 5)), station)"))
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        report = station_exposure(parts, visits)
        total = sum(r["parts_observed"] for r in report.collect())
        plan = report._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert total == rows
    assert "skew=true" in plan
