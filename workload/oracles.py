"""The same answers in plain SQL for the comparison engine, written independently of the Spark code."""

from __future__ import annotations

HOURS = "epoch(l_shipdate) / 3600.0"
K = "(l_partkey % 61 - CASE WHEN l_partkey % 61 > 51 THEN 9 ELSE 0 END)"


def _station(k: str) -> str:
    return (
        f"CONCAT('L', CASE WHEN {k} >= 29 THEN 3 WHEN {k} >= 26 THEN 2 WHEN {k} >= 24 THEN 1 ELSE 0 END, "
        f"'_S', {k})"
    )


# Building blocks, in dependency order.
BLOCKS = {
    "parts": """
        SELECT o_orderkey AS part_id,
               CAST(o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AS TINYINT) AS response
        FROM orders""",
    "station_visits": f"""
        SELECT l_orderkey AS part_id, {_station(K)} AS station,
               MIN({HOURS}) AS first_observed_time, MAX({HOURS}) AS last_observed_time
        FROM lineitem
        GROUP BY ALL""",
    "cells": f"""
        SELECT l_orderkey AS part_id, {K} AS k, l_linenumber AS j,
               MIN(l_extendedprice) FILTER (l_discount <> 0) AS v,
               MIN({HOURS}) FILTER (l_linenumber <> 7 AND NOT (l_returnflag = 'A' AND l_linestatus = 'O')) AS t1,
               MAX({HOURS} + l_quantity) FILTER (l_linenumber <> 7) AS t2
        FROM lineitem
        GROUP BY ALL""",
    "measurements": f"""
        SELECT part_id, {_station("k")} AS station, {_station("k")} || '_F' || (2 * j) AS feature_name,
               v AS measurement_value, {_station("k")} || '_D' || (2 * j + 1) AS date_feature_name,
               t1 AS observed_time
        FROM cells WHERE j <= 6 AND v IS NOT NULL""",
    "wide_visits": f"""
        SELECT part_id, {_station("k")} AS station, MIN(LEAST(t1, t2)) AS first_observed_time,
               MAX(GREATEST(t1, t2)) AS last_observed_time
        FROM cells WHERE t1 IS NOT NULL OR t2 IS NOT NULL
        GROUP BY part_id, k""",
    "parts_more": "SELECT * FROM parts UNION ALL SELECT -s_suppkey, CAST(0 AS TINYINT) FROM supplier",
    "date_ids_more": "SELECT part_id FROM parts UNION ALL SELECT -1000000000 - c_custkey FROM customer",
    "left_ids": """
        SELECT part_id FROM parts_more UNION ALL SELECT -s_suppkey FROM supplier WHERE s_nationkey < 12
        UNION ALL SELECT NULL FROM nation""",
    "right_ids": "SELECT part_id FROM date_ids_more UNION ALL SELECT NULL FROM region",
    "labels_raw": """
        SELECT part_id,
               CAST(CASE WHEN part_id % 97 = 0 THEN NULL WHEN part_id % 89 = 0 THEN 2 ELSE response END AS INT)
                   AS response
        FROM parts""",
    "visits_bad_order": """
        SELECT part_id, station,
               IF(part_id % 31 = 0, last_observed_time, first_observed_time) AS first_observed_time,
               IF(part_id % 31 = 0, first_observed_time, last_observed_time) AS last_observed_time
        FROM station_visits""",
    "visits_more": """
        SELECT * FROM visits_bad_order
        UNION ALL SELECT -1000000000 - c_custkey, 'L0_S0', CAST(0 AS DOUBLE), CAST(1 AS DOUBLE) FROM customer""",
    "keys_raw": "SELECT l_orderkey AS part_id, l_linenumber AS line_no FROM lineitem",
    "numeric_columns": f"""
        SELECT CAST(1 + k * 7 + j - 1 AS INT) AS header_position, k, j,
               {_station("k")} || '_F' || (2 * j) AS column_name
        FROM range(52) s(k), range(1, 8) n(j)""",
    "date_columns": f"""
        SELECT k, j, odd, CAST(k * 12 + (j - 1) * 2 + odd AS INT) AS position,
               {_station("k")} || '_D' || (2 * j + odd) AS column_name
        FROM range(52) s(k), range(1, 7) n(j), range(2) o(odd)""",
    "numeric_coverage": """
        SELECT CAST(c.header_position - 1 AS INT) AS position, c.column_name, c.j,
               COUNT(x.v) AS observed, (SELECT COUNT(*) FROM orders) AS rows
        FROM numeric_columns c LEFT JOIN cells x ON x.k = c.k AND x.j = c.j
        GROUP BY ALL""",
    "date_coverage": """
        SELECT c.position, c.column_name, c.k,
               COUNT(CASE WHEN c.odd = 1 THEN x.t1 ELSE x.t2 END) AS observed,
               (SELECT COUNT(*) FROM orders) AS rows
        FROM date_columns c LEFT JOIN cells x ON x.k = c.k AND x.j = c.j
        GROUP BY ALL""",
    "exposure": """
        SELECT station, COUNT(*) AS parts_observed, CAST(SUM(response) AS BIGINT) AS failed_parts,
               CAST(SUM(response) AS DOUBLE) / COUNT(*) AS failure_rate
        FROM station_visits JOIN parts USING (part_id)
        GROUP BY station""",
    "wide_exposure": """
        SELECT station, COUNT(*) AS parts_observed, CAST(SUM(response) AS BIGINT) AS failed_parts,
               CAST(SUM(response) AS DOUBLE) / COUNT(*) AS failure_rate
        FROM wide_visits JOIN parts USING (part_id)
        GROUP BY station""",
    "wide_routes": """
        SELECT part_id, STRING_AGG(DISTINCT station[1:2], ' ' ORDER BY station[1:2]) AS path,
               MAX(station = 'L3_S32') AS visited_target, BOOL_OR(station[1:2] = 'L3') AS l3
        FROM wide_visits GROUP BY part_id""",
    "routes": """
        SELECT part_id,
               MAX(CAST(station[1:2] = 'L0' AS INT)) AS l0, MAX(CAST(station[1:2] = 'L1' AS INT)) AS l1,
               MAX(CAST(station[1:2] = 'L2' AS INT)) AS l2, MAX(CAST(station[1:2] = 'L3' AS INT)) AS l3,
               MAX(CAST(station = 'L3_S32' AS INT)) AS visited_target,
               STRING_AGG(DISTINCT station[1:2], ' ' ORDER BY station[1:2]) AS path,
               MIN(first_observed_time) FILTER (station[1:2] = 'L3') AS first_line_time
        FROM station_visits GROUP BY part_id""",
    "cohorts": """
        SELECT part_id, visited_target, first_line_time,
               CAST(NTILE(10) OVER (ORDER BY first_line_time, part_id) AS INT) AS time_cohort
        FROM routes WHERE first_line_time IS NOT NULL""",
    "profile": f"""
        SELECT {_station("s.k")} AS station, COUNT(x.part_id) AS parts_visited,
               COALESCE(CAST(SUM(CASE WHEN x.part_id IS NOT NULL THEN p.response END) AS BIGINT), 0) AS failed_parts,
               CAST(SUM(CASE WHEN x.part_id IS NOT NULL THEN p.response END) AS DOUBLE)
                   / NULLIF(COUNT(x.part_id), 0) AS failure_rate
        FROM range(52) s(k)
        LEFT JOIN (SELECT DISTINCT part_id, k FROM cells WHERE t1 IS NOT NULL OR t2 IS NOT NULL) x ON x.k = s.k
        LEFT JOIN parts p ON p.part_id = x.part_id
        GROUP BY s.k""",
}

COUNTS = """COUNT(*) AS parts, CAST(SUM(response) AS BIGINT) AS failed_parts,
       ROUND(CAST(100 AS DOUBLE) * SUM(response) / COUNT(*), 3) AS failure_pct"""

RATE = "CAST(observed AS DOUBLE) / rows"

DISTRIBUTION = f"""COUNT(*) AS columns, MIN({RATE}) AS min_coverage, MEDIAN({RATE}) AS median_coverage,
       MAX({RATE}) AS max_coverage, COUNT(*) FILTER (observed = 0) AS empty_columns,
       COUNT(*) FILTER ({RATE} < 0.10) AS sparse_columns"""

NUMERIC_SHA = """sha256('["Id", ' || (SELECT STRING_AGG('"' || column_name || '"', ', ' ORDER BY header_position)
    FROM numeric_columns) || ', "Response"]')"""
DATE_SHA = """sha256('["Id", ' || (SELECT STRING_AGG('"' || column_name || '"', ', ' ORDER BY position)
    FROM date_columns) || ']')"""

STATION_TABLE = """SELECT station, parts_observed, failed_parts, failure_rate
FROM exposure WHERE parts_observed >= 1000 ORDER BY failure_rate DESC, station"""

PATHS = f"""SELECT COALESCE(path, 'No recorded visits') AS line_group, {COUNTS}
FROM parts LEFT JOIN routes USING (part_id) GROUP BY 1"""

ALIGNMENT = """SELECT
       (SELECT COUNT(*) FROM left_ids) AS left_rows, (SELECT COUNT(*) FROM right_ids) AS right_rows,
       COUNT(*) FILTER (a.part_id = b.part_id) AS matched_ids,
       COUNT(*) FILTER (b.part_id IS NULL) AS left_only_ids,
       COUNT(*) FILTER (a.part_id IS NULL) AS right_only_ids,
       COUNT(*) FILTER (COALESCE(a.n, 0) > 1 OR COALESCE(b.n, 0) > 1) AS duplicate_ids,
       (SELECT COUNT(*) FROM left_ids WHERE part_id IS NULL)
           + (SELECT COUNT(*) FROM right_ids WHERE part_id IS NULL) AS null_ids,
       COUNT(*) FILTER (a.part_id IS NULL OR b.part_id IS NULL OR a.n > 1 OR b.n > 1) = 0
           AND NOT EXISTS (SELECT 1 FROM left_ids WHERE part_id IS NULL)
           AND NOT EXISTS (SELECT 1 FROM right_ids WHERE part_id IS NULL) AS aligned
FROM (SELECT part_id, COUNT(*) AS n FROM left_ids WHERE part_id IS NOT NULL GROUP BY part_id) a
FULL JOIN (SELECT part_id, COUNT(*) AS n FROM right_ids WHERE part_id IS NOT NULL GROUP BY part_id) b
  ON a.part_id = b.part_id"""

NOTE = """(SELECT COUNT(*) || ' numeric features have a matching date column and were loaded; '
        || (SELECT COUNT(*) FROM numeric_columns WHERE (k, 2 * j + 1) NOT IN (SELECT (k, 2 * j + odd) FROM date_columns))
        || ' other feature columns stay in the source file because no measurement time is known for them.'
   FROM numeric_columns WHERE (k, 2 * j + 1) IN (SELECT (k, 2 * j + odd) FROM date_columns))"""

REPORT = f"""SELECT section, name, value FROM (
  SELECT 'source' AS section, 'numeric_file' AS name, 'train_numeric.csv' AS value
  UNION ALL SELECT 'source', 'numeric_columns', CAST((SELECT COUNT(*) + 2 FROM numeric_columns) AS VARCHAR)
  UNION ALL SELECT 'source', 'numeric_header_sha256', {NUMERIC_SHA}
  UNION ALL SELECT 'source', 'date_file', 'train_date.csv'
  UNION ALL SELECT 'source', 'date_columns', CAST((SELECT COUNT(*) + 1 FROM date_columns) AS VARCHAR)
  UNION ALL SELECT 'source', 'date_header_sha256', {DATE_SHA}
  UNION ALL SELECT 'loaded', 'parts', CAST((SELECT COUNT(*) FROM parts) AS VARCHAR)
  UNION ALL SELECT 'loaded', 'failed_parts', CAST((SELECT SUM(response) FROM parts) AS VARCHAR)
  UNION ALL SELECT 'loaded', 'station_observations', CAST((SELECT COUNT(*) FROM wide_visits) AS VARCHAR)
  UNION ALL SELECT 'loaded', 'distinct_stations',
    CAST((SELECT COUNT(DISTINCT station) FROM wide_visits) AS VARCHAR)
  UNION ALL SELECT 'loaded', 'mapped_measurements', CAST((SELECT COUNT(*) FROM measurements) AS VARCHAR)
  UNION ALL SELECT 'loaded', 'mapped_features',
    CAST((SELECT COUNT(DISTINCT feature_name) FROM measurements) AS VARCHAR)
  UNION ALL SELECT 'loaded', 'missing_matched_times',
    CAST((SELECT COUNT(*) FROM measurements WHERE observed_time IS NULL) AS VARCHAR)
  UNION ALL SELECT 'checks', 'part_count', CAST((SELECT COUNT(*) FROM parts) = 1183747 AS VARCHAR)
  UNION ALL SELECT 'checks', 'failure_count', CAST((SELECT SUM(response) FROM parts) = 6879 AS VARCHAR)
  UNION ALL SELECT 'checks', 'station_count',
    CAST((SELECT COUNT(DISTINCT station) FROM wide_visits) = 52 AS VARCHAR)
  UNION ALL SELECT 'checks', 'measurement_count_matches_parquet',
    CAST((SELECT COUNT(*) FROM measurements) = (SELECT COUNT(v) FROM cells WHERE j < 7) AS VARCHAR)
  UNION ALL SELECT 'checks', 'mapped_feature_count',
    CAST((SELECT COUNT(DISTINCT feature_name) FROM measurements) = 312 AS VARCHAR)
  UNION ALL SELECT 'checks', 'matched_times_present',
    CAST((SELECT COUNT(*) FROM measurements WHERE observed_time IS NULL) = 0 AS VARCHAR)
  UNION ALL SELECT 'checks', 'numeric_header_shape',
    CAST((SELECT COUNT(*) + 2 FROM numeric_columns) = 366 AS VARCHAR)
  UNION ALL SELECT 'checks', 'date_header_shape', CAST((SELECT COUNT(*) + 1 FROM date_columns) = 625 AS VARCHAR)
  UNION ALL SELECT 'note', 'coverage_note', {NOTE}
  UNION ALL SELECT 'status', 'status',
    CASE WHEN (SELECT COUNT(*) FROM parts) = 1183747 AND (SELECT SUM(response) FROM parts) = 6879
              AND (SELECT COUNT(DISTINCT station) FROM wide_visits) = 52
              AND (SELECT COUNT(DISTINCT feature_name) FROM measurements) = 312
              AND (SELECT COUNT(*) FROM measurements WHERE observed_time IS NULL) = 0
         THEN 'passed' ELSE 'failed' END) r"""

KEYS = """SELECT 'keys_raw' AS table_name, 'rows' AS check_name, COUNT(*) AS violations FROM keys_raw
UNION ALL SELECT 'keys_raw', 'null_keys', COUNT(*) FROM keys_raw WHERE part_id IS NULL OR line_no IS NULL
UNION ALL SELECT 'keys_raw', 'duplicate_keys', COUNT(*)
  FROM (SELECT 1 FROM keys_raw GROUP BY part_id, line_no HAVING COUNT(*) > 1) d
UNION ALL SELECT 'station_visits', 'rows', COUNT(*) FROM station_visits
UNION ALL SELECT 'station_visits', 'null_keys', COUNT(*) FROM station_visits WHERE part_id IS NULL
UNION ALL SELECT 'station_visits', 'duplicate_keys', COUNT(*)
  FROM (SELECT 1 FROM station_visits GROUP BY part_id, station HAVING COUNT(*) > 1) d
UNION ALL SELECT 'labels_raw', 'part_id_not_null', COUNT(*) FROM labels_raw WHERE part_id IS NULL
UNION ALL SELECT 'labels_raw', 'response_not_null', COUNT(*) FROM labels_raw WHERE response IS NULL
UNION ALL SELECT 'labels_raw', 'response_in_domain', COUNT(*) FROM labels_raw
  WHERE response IS NULL OR response NOT IN (0, 1)
UNION ALL SELECT 'station_visits', 'part_id_not_null', COUNT(*) FROM station_visits WHERE part_id IS NULL
UNION ALL SELECT 'station_visits', 'station_not_null', COUNT(*) FROM station_visits WHERE station IS NULL"""

DIAGNOSTICS = """SELECT 'parts' AS "check", COUNT(*) AS "value" FROM parts_more
UNION ALL SELECT 'failures', COUNT(*) FROM parts_more WHERE response = 1
UNION ALL SELECT 'station_visits', COUNT(*) FROM visits_more
UNION ALL SELECT 'distinct_stations', COUNT(DISTINCT station) FROM visits_more
UNION ALL SELECT 'parts_without_visits', COUNT(*) FROM parts_more
  WHERE part_id NOT IN (SELECT part_id FROM visits_more)
UNION ALL SELECT 'orphan_visits', COUNT(*) FROM visits_more
  WHERE part_id NOT IN (SELECT part_id FROM parts_more)
UNION ALL SELECT 'invalid_time_order', COUNT(*) FROM visits_more
  WHERE first_observed_time > last_observed_time"""

ORACLES = {
    "overall_quality": """SELECT COUNT(*) AS parts_processed, CAST(SUM(response) AS BIGINT) AS failed_parts,
       CAST(SUM(response) AS DOUBLE) / COUNT(*) AS failure_rate FROM parts""",
    "station_exposure": """SELECT e.*, o.r AS overall_failure_rate, e.failure_rate / NULLIF(o.r, 0) AS rate_vs_overall,
       CASE WHEN parts_observed < 1000 OR failed_parts < 20 THEN 'limited_sample'
            ELSE 'sufficient_for_initial_review' END AS review_status
FROM exposure e, (SELECT CAST(SUM(response) AS DOUBLE) / COUNT(*) AS r FROM parts) o""",
    "published_station_exposure": """SELECT e.*, o.r AS overall_failure_rate,
       e.failure_rate / NULLIF(o.r, 0) AS rate_vs_overall,
       CASE WHEN parts_observed < 1000 OR failed_parts < 20 THEN 'limited_sample'
            ELSE 'sufficient_for_initial_review' END AS review_status
FROM wide_exposure e, (SELECT CAST(SUM(response) AS DOUBLE) / COUNT(*) AS r FROM parts) o""",
    "published_top_stations": """SELECT station, parts_observed, failed_parts, failure_rate
FROM wide_exposure WHERE parts_observed >= 50 ORDER BY failure_rate DESC, station LIMIT 15""",
    "published_production_paths": f"""SELECT COALESCE(path, 'No recorded visits') AS line_group, {COUNTS}
FROM parts LEFT JOIN wide_routes USING (part_id) GROUP BY 1""",
    "published_target_vs_line": f"""SELECT IF(visited_target, 'L3_S32 observed', 'Other L3 parts') AS part_group, {COUNTS}
FROM wide_routes JOIN parts USING (part_id) WHERE l3 GROUP BY 1""",
    "published_target_within_line_group": f"""SELECT path AS line_group,
       IF(visited_target, 'L3_S32 observed', 'L3_S32 not observed') AS s32_group, {COUNTS}
FROM wide_routes JOIN parts USING (part_id) WHERE l3 GROUP BY 1, 2""",
    "kept_station_profile": "SELECT * FROM profile",
    "kept_production_paths": f"""SELECT COALESCE(path, 'No recorded visits') AS line_group, {COUNTS}
FROM parts LEFT JOIN wide_routes USING (part_id) GROUP BY 1""",
    "kept_target_within_line_group": f"""SELECT path AS line_group,
       IF(visited_target, 'L3_S32 observed', 'L3_S32 not observed') AS s32_group, {COUNTS}
FROM wide_routes JOIN parts USING (part_id) WHERE l3 GROUP BY 1, 2""",
    "kept_parts_without_visits": "SELECT * FROM parts_more WHERE part_id NOT IN (SELECT part_id FROM wide_visits)",
    "measurement_coverage": """SELECT station, COUNT(*) AS measurements,
       COUNT(DISTINCT feature_name) AS features, COUNT(DISTINCT part_id) AS parts
FROM measurements GROUP BY station""",
    "line_measurement_coverage": """SELECT station[1:2] AS station_group, COUNT(*) AS measurements,
       COUNT(DISTINCT feature_name) AS features, COUNT(DISTINCT part_id) AS parts
FROM measurements GROUP BY 1""",
    "orphan_probe": """SELECT 'station_visits' AS visits_table,
       EXISTS (SELECT 1 FROM station_visits WHERE part_id NOT IN (SELECT part_id FROM parts)) AS has_orphans
UNION ALL SELECT 'visits_more',
       EXISTS (SELECT 1 FROM visits_more WHERE part_id NOT IN (SELECT part_id FROM parts))""",
    "station_table": STATION_TABLE,
    "top_stations": f"{STATION_TABLE} LIMIT 15",
    "production_paths": PATHS,
    "paths_by_volume": f"{PATHS} ORDER BY parts DESC, line_group",
    "target_vs_line": f"""SELECT IF(visited_target = 1, 'L3_S32 observed', 'Other L3 parts') AS part_group, {COUNTS}
FROM routes JOIN parts USING (part_id) WHERE l3 = 1 GROUP BY 1""",
    "target_vs_line_by_rate": f"""SELECT IF(visited_target = 1, 'L3_S32 observed', 'Other L3 parts') AS part_group,
       {COUNTS}
FROM routes JOIN parts USING (part_id) WHERE l3 = 1 GROUP BY 1 ORDER BY failure_pct DESC, part_group""",
    "target_within_line_group": f"""SELECT path AS line_group,
       IF(visited_target = 1, 'L3_S32 observed', 'L3_S32 not observed') AS s32_group, {COUNTS}
FROM routes JOIN parts USING (part_id) WHERE l3 = 1 GROUP BY 1, 2""",
    "target_within_cohort": f"""SELECT time_cohort,
       IF(visited_target = 1, 'S32 observed', 'S32 not observed') AS s32_group, {COUNTS}
FROM cohorts JOIN parts USING (part_id) GROUP BY 1, 2""",
    "part_route_profile": "SELECT part_id, l0, l1, l2, l3, visited_target, first_line_time FROM routes",
    "time_cohorts": "SELECT * FROM cohorts",
    "build_parts": "SELECT * FROM parts",
    "build_station_visits": "SELECT * FROM wide_visits",
    "build_mapped_measurements": "SELECT * FROM measurements",
    "published_parts": "SELECT * FROM parts",
    "published_station_visits": "SELECT * FROM wide_visits",
    "published_measurements": "SELECT * FROM measurements",
    "station_measurement_coverage": """SELECT station, COUNT(*) AS measurements,
       COUNT(DISTINCT feature_name) AS features, COUNT(DISTINCT part_id) AS parts
FROM measurements WHERE station = 'L3_S32' GROUP BY station""",
    "measurement_validation": """SELECT COUNT(*) AS measurements, COUNT(DISTINCT feature_name) AS features,
       COUNT(*) - COUNT(observed_time) AS missing_times FROM measurements""",
    "load_diagnostics": DIAGNOSTICS,
    "orphan_visits": """SELECT part_id, COUNT(*) AS visits FROM visits_more
WHERE part_id NOT IN (SELECT part_id FROM parts) GROUP BY part_id""",
    "parts_without_visits": "SELECT * FROM parts_more WHERE part_id NOT IN (SELECT part_id FROM station_visits)",
    "invalid_time_order": "SELECT * FROM visits_bad_order WHERE first_observed_time > last_observed_time",
    "key_violations": KEYS,
    "source_alignment": ALIGNMENT,
    "ingestion_report": REPORT,
    "id_profile": """SELECT 'numeric' AS source, COUNT(*) AS rows, COUNT(DISTINCT part_id) AS unique_ids,
       COUNT(*) - COUNT(DISTINCT part_id) AS duplicate_ids, CAST(0 AS BIGINT) AS missing_ids FROM parts
UNION ALL SELECT 'dates', COUNT(*), COUNT(DISTINCT part_id), COUNT(*) - COUNT(DISTINCT part_id), 0 FROM parts
UNION ALL SELECT 'keys_raw', COUNT(*), COUNT(DISTINCT part_id), COUNT(*) - COUNT(DISTINCT part_id), 0 FROM keys_raw""",
    "label_counts": "SELECT response, COUNT(*) AS rows FROM labels_raw GROUP BY response",
    "id_set_difference": """SELECT
  (SELECT COUNT(*) FROM (SELECT part_id FROM parts_more EXCEPT SELECT part_id FROM date_ids_more) l) AS only_left,
  (SELECT COUNT(*) FROM (SELECT part_id FROM date_ids_more EXCEPT SELECT part_id FROM parts_more) r) AS only_right""",
    "column_coverage": f"""SELECT 'numeric' AS source, position, column_name, observed, rows, {RATE} AS coverage
FROM numeric_coverage UNION ALL SELECT 'dates', position, column_name, observed, rows, {RATE} FROM date_coverage""",
    "coverage_distribution": f"""SELECT 'numeric' AS source, {DISTRIBUTION} FROM numeric_coverage
UNION ALL SELECT 'dates', {DISTRIBUTION} FROM date_coverage""",
    "station_profile": "SELECT * FROM profile",
    "most_visited_stations": "SELECT * FROM profile ORDER BY parts_visited DESC, station LIMIT 10",
    "least_visited_stations": "SELECT * FROM profile ORDER BY parts_visited, station DESC LIMIT 10",
    "sql_batch": """SELECT station[1:2] AS line, '1.10' AS exact, COUNT(*) AS visits, COUNT(DISTINCT part_id) AS parts,
       CAST(SUM(response) AS BIGINT) AS failed_visits,
       ROUND(CAST(100 AS DOUBLE) * SUM(response) / COUNT(*), 3) AS failed_pct
FROM station_visits JOIN parts USING (part_id) GROUP BY 1""",
    "metric_views": """SELECT station, failure_rate / NULLIF(o.r, 0) AS rate_vs_overall, o.n AS parts_processed
FROM exposure, (SELECT CAST(SUM(response) AS DOUBLE) / COUNT(*) AS r, COUNT(*) AS n FROM parts) o""",
}

# Blocks each block reads.
NEEDS = {
    "measurements": ["cells"],
    "wide_visits": ["cells"],
    "parts_more": ["parts"],
    "date_ids_more": ["parts"],
    "left_ids": ["parts_more"],
    "right_ids": ["date_ids_more"],
    "visits_more": ["visits_bad_order"],
    "labels_raw": ["parts"],
    "visits_bad_order": ["station_visits"],
    "numeric_coverage": ["numeric_columns", "cells"],
    "date_coverage": ["date_columns", "cells"],
    "exposure": ["station_visits", "parts"],
    "wide_exposure": ["wide_visits", "parts"],
    "wide_routes": ["wide_visits"],
    "routes": ["station_visits"],
    "cohorts": ["routes", "station_visits"],
    "profile": ["cells", "parts"],
}


def _with_blocks(body: str) -> str:
    wanted = {name for name in BLOCKS if _mentions(body, name)}
    while True:
        more = {need for name in wanted for need in NEEDS.get(name, [])} - wanted
        if not more:
            break
        wanted |= more
    blocks = [f"{name} AS ({sql.strip()}\n)" for name, sql in BLOCKS.items() if name in wanted]
    if body.startswith("WITH "):
        return f"WITH {', '.join(blocks)}, {body[5:]}"
    return f"WITH {', '.join(blocks)}\n{body}"


def _mentions(text: str, name: str) -> bool:
    words = text.replace("(", " ").replace(")", " ").replace(",", " ").split()
    return any(words[i] in ("FROM", "JOIN") and words[i + 1] == name for i in range(len(words) - 1))


def oracle_sql() -> dict[str, str]:
    return {name: _with_blocks(body) for name, body in ORACLES.items()}
