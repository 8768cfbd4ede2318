import pytest
from conftest import tuples
from pyspark.errors import PySparkException

from millwright.plans.profiles import (
    column_coverage,
    coverage_distribution,
    id_profile,
    id_set_difference,
    label_counts,
    least_visited,
    most_visited,
    station_profile,
)
from millwright.sources import read_wide_csv


def wide(spark, rows, names, types="DOUBLE"):
    schema = ", ".join(f"{n} {'BIGINT' if n == 'Id' else 'INT' if n == 'Response' else types}" for n in names)
    return spark.createDataFrame(rows, schema).repartition(4)


def test_coverage_edges(spark):
    rows = [(i, None, 1.0 if i < 9 else None, 1.0 if i < 10 else None, 2.0, 0) for i in range(100)]
    df = wide(spark, rows, ["Id", "a", "b", "c", "d", "Response"])
    coverage = column_coverage(df)
    assert tuples(coverage) == [
        (0, "a", 0, 100, 0.0), (1, "b", 9, 100, 0.09), (2, "c", 10, 100, 0.1), (3, "d", 100, 100, 1.0),
    ]
    assert tuple(coverage_distribution(coverage).first()) == (4, 0.0, 0.095, 1.0, 1, 2)
    assert tuples(column_coverage(df.limit(0)), "observed", "rows", "coverage") == [(0, 0, None)] * 4


def test_ids_and_labels(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (1, None), (2, 0), (None, 0)], "Id BIGINT, Response INT")
    assert tuple(id_profile(df).first()) == (5, 2, 2, 1)
    assert tuples(label_counts(df)) == [(None, 1), (0, 3), (1, 1)]
    other = spark.createDataFrame([(2,), (3,), (3,), (4,), (None,)], "Id BIGINT")
    assert tuple(id_set_difference(df, other).first()) == (1, 2)


def test_station_profile(spark, csv_file):
    dates = read_wide_csv(
        spark, csv_file("d.csv", "Id,L0_S0_D1,L0_S0_D2,L1_S1_D1,L2_S9_D1\n1,1,,2,\n2,,3,,\n3,,,,\n5,1,1,1,\n")
    )
    labels = read_wide_csv(spark, csv_file("n.csv", "Id,Response\n1,1\n2,0\n3,1\n4,1\n"))
    profile = station_profile(dates, labels)
    assert [tuple(r) for r in profile.collect()] == [
        ("L0_S0", 2, 1, 0.5), ("L1_S1", 1, 1, 1.0), ("L2_S9", 0, 0, None),
    ]
    assert [r["station"] for r in most_visited(profile, 2).collect()] == ["L0_S0", "L1_S1"]
    assert [r["station"] for r in least_visited(profile, 2).collect()] == ["L2_S9", "L1_S1"]


def test_station_profile_wants_unique_ids(spark, csv_file):
    dates = read_wide_csv(spark, csv_file("d.csv", "Id,L0_S0_D1\n1,1\n1,2\n"))
    labels = read_wide_csv(spark, csv_file("n.csv", "Id,Response\n1,1\n"))
    with pytest.raises(PySparkException, match="is repeated"):
        station_profile(dates, labels).collect()
