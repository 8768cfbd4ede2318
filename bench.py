"""Time every registered query and print one JSON line.

Environment: ``BENCH_SF_DIR`` (default ``/root/testdata/sf0.1``), ``BENCH_CPUS`` (default 8),
``BENCH_QUERIES`` (comma-separated names, default all). The fixture sources and the published
tables are written before the clock starts; their time is reported apart as ``setup``.
"""

from __future__ import annotations

import json
import os
import time

from millwright.session import build_session
from workload import fixtures, queries


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = [name for name in os.environ.get("BENCH_QUERIES", "").split(",") if name]
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    setup = {}
    started = time.perf_counter()
    run(fixtures.station_visits(spark, sf_dir))
    setup["warm_up"] = round(time.perf_counter() - started, 3)
    started = time.perf_counter()
    fixtures.wide_sources(spark, sf_dir)
    setup["wide_csv"] = round(time.perf_counter() - started, 3)
    started = time.perf_counter()
    fixtures.published(spark, sf_dir)
    setup["full_load"] = round(time.perf_counter() - started, 3)

    timings = {}
    for name, query in queries.registered().items():
        if chosen and name not in chosen:
            continue
        started = time.perf_counter()
        run(query(spark, sf_dir))
        timings[name] = round(time.perf_counter() - started, 3)

    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": int(cpus),
                "setup": setup,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
