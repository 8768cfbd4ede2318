import pytest
from conftest import parts_frame, tuples, visits_frame
from pyspark.errors import PySparkException

from millwright.contracts import GateError
from millwright.operators import gates
from millwright.plans.diagnostics import load_diagnostics


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "Id BIGINT").repartition(3)


def test_key_report(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (None, "a"), (2, None), (3, "c")], "p BIGINT, s STRING")
    assert tuple(gates.key_report(df, ["p", "s"]).first()) == (6, 2, 1)
    assert tuple(gates.key_report(df.limit(0), ["p"]).first()) == (0, 0, 0)


def test_column_violations(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (4, None), (None, 1)], "part_id BIGINT, response INT")
    report = gates.column_violations(df, ["part_id", "response"], {"response": [0, 1]})
    assert report.first().asDict() == {"part_id_not_null": 1, "response_not_null": 1, "response_in_domain": 2}
    with pytest.raises(GateError):
        gates.require_columns(df, "parts", [], {"response": [0, 1]})


def test_alignment(spark):
    same = gates.source_alignment(ids(spark, [3, 1, 2]), ids(spark, [1, 2, 3])).first()
    assert same["aligned"] and same["matched_ids"] == 3
    assert gates.require_aligned(ids(spark, [3, 1, 2]), ids(spark, [1, 2, 3])) == 3
    for left, right, field in (
        ([1, 2], [1], "left_only_ids"),
        ([1], [1, 2], "right_only_ids"),
        ([1, 1, 2], [1, 2], "duplicate_ids"),
        ([1, 2], [1, 2, 2], "duplicate_ids"),
        ([1, None], [1], "null_ids"),
    ):
        report = gates.source_alignment(ids(spark, left), ids(spark, right)).first()
        assert not report["aligned"] and report[field] == 1
        with pytest.raises(GateError):
            gates.require_aligned(ids(spark, left), ids(spark, right))


def test_anti_joins_and_time_order(spark):
    parts = parts_frame(spark, [(1, 0), (2, 1), (3, 0)])
    visits = visits_frame(spark, [(1, "a"), (9, "a"), (9, "b"), (2, "a", 5.0, 1.0), (2, "b", None, 1.0), (None, "a")])
    assert tuples(gates.unknown_parts(visits, parts)) == [(None, 1), (9, 2)]
    assert tuples(gates.parts_without(parts, visits)) == [(3, 0)]
    assert tuples(gates.invalid_time_order(visits)) == [(2, "a", 5.0, 1.0)]
    with pytest.raises(GateError):
        gates.require_none(gates.unknown_parts(visits, parts), "orphans")


def test_load_diagnostics(spark):
    parts = parts_frame(spark, [(1, 0), (2, 1), (3, 0)])
    visits = visits_frame(spark, [(1, "a"), (9, "a"), (9, "b"), (2, "a", 5.0, 1.0)])
    assert dict(tuples(load_diagnostics(parts, visits))) == {
        "parts": 3, "failures": 1, "station_visits": 4, "distinct_stations": 2,
        "parts_without_visits": 1, "orphan_visits": 2, "invalid_time_order": 1,
    }
    empty = dict(tuples(load_diagnostics(parts.limit(0), visits.limit(0))))
    assert set(empty.values()) == {0} and len(empty) == 7


def test_one_to_one(spark):
    left, right = ids(spark, [1, 2]).selectExpr("Id", "1 AS a"), ids(spark, [2, 3]).selectExpr("Id", "2 AS b")
    assert tuples(gates.one_to_one(left, right)) == [(2, 1, 2)]
    for bad in ([1, 1], [2, 2], [None, None]):
        for merged in (gates.one_to_one(ids(spark, bad), right), gates.one_to_one(left, ids(spark, bad))):
            with pytest.raises(PySparkException, match="is repeated"):
                merged.collect()


def test_one_to_one_of_the_same_ids(spark):
    left = ids(spark, [1, 2]).selectExpr("Id", "Id * 10 AS `a.b`", "array(Id) AS c")
    right = ids(spark, [2, 1]).selectExpr("Id", "Id * 100 AS d")
    assert tuples(gates.one_to_one(left, right, aligned=True)) == [(1, 10, [1], 100), (2, 20, [2], 200)]
    for other in ([1], [1, 2, 3], [1, 2, None], [1, 3]):
        with pytest.raises(PySparkException, match="differs"):
            gates.one_to_one(left, ids(spark, other), aligned=True).collect()
    assert gates.one_to_one(left.limit(0), right.limit(0), aligned=True).collect() == []


def test_row_count_gate():
    gates.require_rows(5, 5, "x")
    gates.require_rows(5, None, "x")
    with pytest.raises(GateError):
        gates.require_rows(5, 6, "x")
