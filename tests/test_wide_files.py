"""The wide sources as files: one side at a time, and small on disk."""

import datetime

import pytest

from conftest import tuples
from workload import fixtures as fx, queries as registry

LINES = (
    "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp"
)


@pytest.fixture
def small_dir(spark, tmp_path):
    """400 orders, every other one with a line item."""
    orders = [(i, "F" if i % 5 == 0 else "O", "1-URGENT") for i in range(400)]
    at = datetime.datetime(1995, 1, 1, 12)
    lines = [(i, i, 1 + i % 7, 3.0, i + 0.5, 0.05, "N", "O", at) for i in range(0, 400, 2)]
    schema = "o_orderkey long, o_orderstatus string, o_orderpriority string"
    spark.createDataFrame(orders, schema).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, LINES).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def stored_bytes(spark, path):
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(found).getLength()


def test_parts_write_the_numeric_side_only(spark, small_dir):
    assert registry.build_parts(spark, small_dir).count() == 400
    sides = [side for _, folder, side in fx._written if folder == small_dir]
    assert sides == ["numeric"]
    assert registry.build_station_visits(spark, small_dir).count() == len([i for i in range(0, 400, 2) if i % 7 != 6])


def test_separators_take_no_room(spark, small_dir, tmp_path):
    for side in ("numeric", "dates"):
        fx.wide_frame(spark, small_dir, side).write.option("header", True).csv(f"{tmp_path}/plain/{side}")
        plain = stored_bytes(spark, f"{tmp_path}/plain/{side}")
        assert stored_bytes(spark, fx.wide_file(spark, small_dir, side)) < plain / 4


def test_files_that_one_task_reads_are_bounded(spark, small_dir, monkeypatch):
    whole = tuples(fx.wide_source(spark, small_dir, "numeric"), "Id", "Response", "L0_S0_F2")
    monkeypatch.setattr(fx, "ROWS_PER_FILE", 10)
    monkeypatch.setattr(fx, "_written", {})
    again = fx.wide_source(spark, small_dir, "numeric")
    assert tuples(again, "Id", "Response", "L0_S0_F2") == whole
    assert len(again.inputFiles()) >= 40


@pytest.fixture
def no_broadcast(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.mark.parametrize("side", ["numeric", "dates"])
def test_line_items_cross_one_shuffle(spark, small_dir, no_broadcast, side):
    plan = fx.wide_frame(spark, small_dir, side)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(part_id") == plan.count("Exchange ") == 2  # parts, line items


@pytest.mark.parametrize("side", ["numeric", "dates"])
def test_tasks_that_gather_line_items_follow_their_number(spark, small_dir, no_broadcast, monkeypatch, side):
    whole = fx.wide_frame(spark, small_dir, side)
    rows = tuples(whole)
    assert len(rows) == 400 and whole.rdd.getNumPartitions() == 8
    monkeypatch.setattr(fx, "LINES_PER_TASK", 10)
    split = fx.wide_frame(spark, small_dir, side)
    assert tuples(split) == rows and split.rdd.getNumPartitions() == 20


def test_a_cell_of_several_line_items_keeps_its_extremes(spark, tmp_path):
    """Part 1 has three line items in one cell, one of them without a value, and one beyond the timed slots."""
    at = [datetime.datetime(1995, 1, 1, hour) for hour in (5, 3, 4)]
    lines = [(1, 61, 1, float(q), p, d, "N", "O", t) for q, p, d, t in zip((1, 9, 2), (7.0, 8.0, 6.0), (0.1, 0.1, 0.0), at)]
    lines.append((1, 62, 7, 1.0, 4.0, 0.1, "N", "O", at[0]))
    spark.createDataFrame([(1, "O", "1-URGENT")], "o_orderkey long, o_orderstatus string, o_orderpriority string").write.parquet(
        f"{tmp_path}/orders.parquet"
    )
    spark.createDataFrame(lines, LINES).write.parquet(f"{tmp_path}/lineitem.parquet")
    (numeric,) = fx.wide_frame(spark, str(tmp_path), "numeric").collect()
    assert {k: v for k, v in numeric.asDict().items() if v is not None} == {
        "Id": 1, "Response": 0, "L0_S0_F2": 7.0, "L0_S1_F14": 4.0
    }
    (dates,) = fx.wide_frame(spark, str(tmp_path), "dates").collect()
    day = 24 * (datetime.date(1995, 1, 1) - datetime.date(1970, 1, 1)).days
    assert {k: v for k, v in dates.asDict().items() if v is not None} == {
        "Id": 1, "L0_S0_D2": day + 12.0, "L0_S0_D3": day + 3.0
    }


@pytest.mark.parametrize("side", ["numeric", "dates"])
@pytest.mark.parametrize("keys", [[(61, None)], [(None, 1)], [(61, 8), (62, 1)]])
def test_line_items_without_a_slot_of_their_own_fail(spark, tmp_path, side, keys):
    """A missing number, and two numbers of one slot, also where the line item has nothing to show."""
    at = datetime.datetime(1995, 1, 1)
    lines = [(1, k, j, 1.0, 5.0, 0.0, "N", "O", None) for k, j in keys[:1]] + [(1, k, j, 1.0, 5.0, 0.1, "N", "O", at) for k, j in keys[1:]]
    orders = spark.createDataFrame([(1, "O", "1-URGENT")], "o_orderkey long, o_orderstatus string, o_orderpriority string")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, LINES).write.parquet(f"{tmp_path}/lineitem.parquet")
    with pytest.raises(Exception, match="MAP_KEY"):
        fx.wide_frame(spark, str(tmp_path), side).collect()
