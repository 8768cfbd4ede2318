"""Run registered queries next to their oracle SQL and compare names and values."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, list):
        return tuple(_plain(v) for v in value)
    return value


def _rows(columns: list[str], rows: list) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(spark_df, con, sql: str) -> str | None:
    """None when both sides agree, else a short description."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(names)}"
    same_kind = {
        "bigint": "BIGINT", "int": "INTEGER", "tinyint": "TINYINT", "double": "DOUBLE", "string": "VARCHAR",
        "boolean": "BOOLEAN",
    }
    odd = {c: (k, kinds[c]) for c, k in spark_df.dtypes if same_kind.get(k) != kinds[c]}
    if odd:
        return f"types {odd}"
    expected = _rows(names, result.fetchall())
    actual = _rows(spark_df.columns, spark_df.collect())
    if expected == actual:
        return None if sum(actual.values()) else "no rows on either side"
    extra, missing = actual - expected, expected - actual
    return (
        f"{sum(actual.values())} vs {sum(expected.values())} rows; only Spark {list(extra)[:2]}; "
        f"only oracle {list(missing)[:2]}"
    )
