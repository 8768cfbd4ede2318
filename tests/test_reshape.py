import math
import random

import pytest
from conftest import tuples
from pyspark.errors import PySparkException
from pyspark.sql import types as T

from millwright.operators.catalog import pairs_of
from millwright.operators.reshape import mapped_measurements, pack_times, pack_values, station_visits
from millwright.plans.loads import build_mapped_measurements
from millwright.sources import read_wide_csv, wide_schema


def test_visits_micro(spark, csv_file):
    path = csv_file(
        "d.csv",
        "Id,L0_S0_D1,L0_S0_D2,L0_S0_D3,L1_S9_D1,foo,L2_S2_D1,L2_S2_D4\n"
        "1,5,,3,7,,,\n"  # partly missing, and a station with one column
        "2,,,,,,,\n"  # seen nowhere
        "3,NaN,NaN,2,,4,,\n"
        "4,,,,,,-inf,inf\n",
    )
    assert tuples(station_visits(read_wide_csv(spark, path))) == [
        (1, "L0_S0", 3.0, 5.0),
        (1, "L1_S9", 7.0, 7.0),
        (3, "L0_S0", 2.0, 2.0),
        (3, "foo", 4.0, 4.0),
        (4, "L2_S2", -math.inf, math.inf),
    ]


def test_measurements_micro(spark, csv_file):
    numeric = csv_file(
        "n.csv",
        "Id,L0_S0_F007,L0_S0_F1,L0_S0_F7,L1_S2_F4,X_F1,Response\n1,1.5,9,2.5,,3,0\n2,,9,,inf,,1\n3,,,,,,0\n",
    )
    dates = csv_file("d.csv", "Id,L1_S2_D5,L0_S0_D8\n3,1,1\n1,8,\n2,,4\n")  # another row order
    got = mapped_measurements(read_wide_csv(spark, numeric), read_wide_csv(spark, dates))
    assert got.columns == [
        "part_id", "station", "feature_name", "measurement_value", "date_feature_name", "observed_time",
    ]
    assert tuples(got) == [
        (1, "L0_S0", "L0_S0_F007", 1.5, "L0_S0_D8", None),  # value without a time stays
        (1, "L0_S0", "L0_S0_F7", 2.5, "L0_S0_D8", None),  # two features share a time column
        (2, "L1_S2", "L1_S2_F4", math.inf, "L1_S2_D5", None),
    ]


def test_pair_count_gate(spark, csv_file):
    numeric = csv_file("n.csv", "Id,L0_S0_F1,Response\n1,1,0\n")
    dates = csv_file("d.csv", "Id,L0_S0_D2\n1,1\n")
    frames = read_wide_csv(spark, numeric), read_wide_csv(spark, dates)
    assert build_mapped_measurements(*frames, expected_pairs=1).count() == 1
    with pytest.raises(ValueError):
        build_mapped_measurements(*frames, expected_pairs=2)
    other = read_wide_csv(spark, csv_file("e.csv", "Id,L0_S0_D2\n2,1\n"))
    with pytest.raises(PySparkException, match="differs"):
        build_mapped_measurements(frames[0], other).count()


def test_random_wide_tables_against_brute_force(spark):
    rng = random.Random(7)
    stations = [f"L{i % 4}_S{i}" for i in range(12)]
    features = [f"{s}_F{2 * j}" for s in stations for j in range(rng.randint(1, 4))]
    times = [f"{s}_D{n}" for s in stations for n in range(1, 6) if rng.random() < 0.8]
    cell = lambda p: round(rng.uniform(-9, 9), 3) if rng.random() < p else None
    numeric_rows = [(i, *[cell(0.3) for _ in features], 0) for i in range(200)]
    date_rows = [(i, *[cell(0.2) for _ in times]) for i in range(200)]
    numeric_names, date_names = ["Id", *features, "Response"], ["Id", *times]
    numeric = spark.createDataFrame(numeric_rows, wide_schema(numeric_names)).repartition(5)
    dates = spark.createDataFrame(date_rows, wide_schema(date_names)).repartition(3)

    visits, found = [], []
    time_of = {(row[0], name): row[i + 1] for row in date_rows for i, name in enumerate(times)}
    for row in date_rows:
        for s in stations:
            seen = [v for n, v in zip(times, row[1:]) if n.startswith(s + "_") and v is not None]
            if seen:
                visits.append((row[0], s, min(seen), max(seen)))
    for row in numeric_rows:
        for name, value in zip(features, row[1:]):
            station, number = name.rsplit("_F", 1)
            date = f"{station}_D{int(number) + 1}"
            if date in times and value is not None:
                found.append((row[0], station, name, value, date, time_of[row[0], date]))
    assert tuples(station_visits(dates)) == sorted(visits)
    key = lambda r: (r[0], r[2])
    got = [tuple(r) for r in mapped_measurements(numeric, dates).collect()]
    assert sorted(got, key=key) == sorted(found, key=key)


def test_wide_join_is_never_a_broadcast(spark):
    schema = T.StructType([T.StructField(n, T.LongType() if n == "Id" else T.DoubleType()) for n in ("Id", "L0_S0_F1")])
    numeric = spark.createDataFrame([(1, 2.0)], schema)
    dates = spark.createDataFrame([(1, 2.0)], schema).withColumnRenamed("L0_S0_F1", "L0_S0_D2")
    plan = mapped_measurements(numeric, dates)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_empty_cells_do_not_travel(spark):
    """Rows that the wide merge moves and sorts grow with their filled cells, not with the width of the source."""
    stations = [f"L0_S{i}" for i in range(300)]
    features, times = [f"{s}_F2" for s in stations], [f"{s}_D3" for s in stations]
    rows = [(p, *[float(p) if i == p else None for i in range(300)]) for p in range(20)]
    numeric = spark.createDataFrame([(*r, 0) for r in rows], wide_schema(["Id", *features, "Response"]))
    dates = spark.createDataFrame(rows, wide_schema(["Id", *times]))
    pairs = pairs_of(numeric, dates)
    for packed in (pack_values(numeric, pairs), pack_times(dates, pairs)):
        assert max(len(str(row[1])) for row in packed.collect()) < 100
    assert tuples(mapped_measurements(numeric, dates, pairs), "part_id", "measurement_value", "observed_time") == [
        (p, float(p), float(p)) for p in range(20)
    ]
