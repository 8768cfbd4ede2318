"""Constraint checks. Spark tables carry no keys, so loads run these before publishing."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..contracts import ID, GateError


def key_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per key, combined before the shuffle so that a repeated key stays cheap."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def key_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: ``rows``, ``null_keys`` (rows) and ``duplicate_keys`` (key values seen twice or more)."""
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    return key_counts(df, keys).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(missing, F.col("n"))), F.lit(0)).alias("null_keys"),
        F.count_if(~missing & (F.col("n") > 1)).alias("duplicate_keys"),
    )


def column_violations(
    df: DataFrame, required: Sequence[str] = (), allowed: dict[str, Sequence] | None = None
) -> DataFrame:
    """One row with a violation count per NOT NULL column and per value domain; one scan."""
    checks = [F.count_if(F.col(c).isNull()).alias(f"{c}_not_null") for c in required]
    for c, values in (allowed or {}).items():
        inside = F.coalesce(F.col(c).isin(list(values)), F.lit(False))
        checks.append(F.count_if(~inside).alias(f"{c}_in_domain"))
    return df.agg(*checks)


def as_rows(one_row: DataFrame, name: str = "check", value: str = "value") -> DataFrame:
    """A one-row report turned into ``name, value`` rows."""
    return one_row.select(
        F.inline(
            F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("long").alias(value)) for c in one_row.columns])
        )
    )


def id_balance(left: DataFrame, right: DataFrame, key: str = ID) -> DataFrame:
    """Per id, how many rows each side has.

    A union and one aggregate instead of a full outer join: both sides are combined before the
    shuffle, and no id, however often repeated, can multiply rows.
    """
    both = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(
        right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    return both.groupBy(key).agg(F.sum("l").alias("left_rows"), F.sum("r").alias("right_rows"))


def source_alignment(left: DataFrame, right: DataFrame, key: str = ID) -> DataFrame:
    """One row comparing the id sets of two sources; ``aligned`` when they match one to one."""
    known = F.col(key).isNotNull()
    balance = id_balance(left, right, key).agg(
        F.coalesce(F.sum("left_rows"), F.lit(0)).alias("left_rows"),
        F.coalesce(F.sum("right_rows"), F.lit(0)).alias("right_rows"),
        F.count_if(known & (F.col("left_rows") > 0) & (F.col("right_rows") > 0)).alias("matched_ids"),
        F.count_if(known & (F.col("right_rows") == 0)).alias("left_only_ids"),
        F.count_if(known & (F.col("left_rows") == 0)).alias("right_only_ids"),
        F.count_if(known & ((F.col("left_rows") > 1) | (F.col("right_rows") > 1))).alias("duplicate_ids"),
        F.coalesce(F.sum(F.when(~known, F.col("left_rows") + F.col("right_rows"))), F.lit(0)).alias("null_ids"),
    )
    problems = F.col("left_only_ids") + F.col("right_only_ids") + F.col("duplicate_ids") + F.col("null_ids")
    return balance.withColumn("aligned", problems == 0)


def unknown_parts(rows: DataFrame, parts: DataFrame, key: str = "part_id", counted: str = "rows") -> DataFrame:
    """Keys of ``rows`` that no part has, with how many rows they hold (anti join).

    Rows are counted per key first: the join then moves one row per key, not one per visit.
    """
    per_key = rows.groupBy(key).agg(F.count(F.lit(1)).alias(counted))
    return per_key.join(parts.select(F.col("part_id").alias(key)), key, "left_anti")


# --- probing for unknown parts: a blocked Bloom filter in ordinary columns ------------------------

FILTER_BYTES = 64 << 20  # the most that a filter may send to every task
BITS_PER_KEY = 12
BLOCK_BITS = 1 << 16
_PROBES = 4  # of 16 bits each, out of one 64-bit hash


def _slots(key: str, blocks: int) -> tuple[Column, list[Column]]:
    """Block of a key, and the bits that it sets there."""
    bits = F.xxhash64(F.lit(1), key)
    return (
        F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"),
        [F.shiftrightunsigned(bits, 16 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int") for i in range(_PROBES)],
    )


def key_filter(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """``block, words``: a Bloom filter of the non-null keys, one row of 1,024 numbers per block.

    Keys cross one shuffle, by block; all further grouping stays inside the partitions. A key that
    repeats sets the same bits.
    """
    block, bits = _slots(key, blocks)
    ones = keys.where(F.col(key).isNotNull()).select(block.alias("block"), F.array(*bits).alias("bits"), F.lit(1).cast("long").alias("one"))
    # One zero for every word of every block, so that the words of a block need no filling up.
    every = F.sequence(F.lit(0), F.lit(BLOCK_BITS - 64), F.lit(64))
    zeros = keys.sparkSession.range(blocks).select(
        F.col("id").cast("int").alias("block"), every.alias("bits"), F.lit(0).cast("long").alias("one")
    )
    by_word = (
        ones.unionAll(zeros)
        .repartition("block")
        .select("block", "one", F.explode("bits").alias("bit"))
        .groupBy("block", F.shiftright("bit", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(one, bit & 63)")).alias("value"))
    )
    words = F.sort_array(F.collect_list(F.struct("word", "value")))["value"]
    return by_word.groupBy("block").agg(words.alias("words"))


def rows_outside(rows: DataFrame, filled: DataFrame, key: str, blocks: int) -> DataFrame:
    """``rows`` whose key the filter has certainly never seen; narrow, so a limit on it stops early.

    Never a row whose key is known. A share of the unknown ones, about one in 150 for a filter of full
    size, looks known and is missed.
    """
    block, bits = _slots(key, blocks)
    found = rows.withColumn("_block", block).join(F.broadcast(filled.withColumnRenamed("block", "_block")), "_block", "left")
    known = [
        F.call_function("getbit", F.get("words", F.shiftright(bit, 6)), bit.bitwiseAND(F.lit(63))) == 1
        for bit in bits
    ]
    seen = F.col(key).isNotNull() & F.coalesce(reduce(lambda a, b: a & b, known), F.lit(False))
    return found.where(~seen).select(*[F.col(f"`{c}`") for c in rows.columns])


def first_unknown(rows: DataFrame, parts: DataFrame, key: str = "part_id", filter_bytes: int = FILTER_BYTES) -> Row | None:
    """A row whose key is no part, or None if the probe meets none.

    Stops at the first such row: on a table with an early one only a few tasks run, and nothing is
    aggregated. What the filter rejects is looked up once more among the parts. None is no proof, since
    a few unknown keys look known; :func:`require_known` settles that. With more parts than the filter
    holds within ``filter_bytes``, the probe covers an equal share of all ids.
    """
    count, room = parts.count(), max(1, filter_bytes // (BLOCK_BITS // 8))
    blocks = min(room, max(1, -(-count * BITS_PER_KEY // BLOCK_BITS)))
    slices = max(1, -(-count * BITS_PER_KEY // (room * BLOCK_BITS)))
    named = parts.select(F.col("part_id").alias(key))
    if slices > 1:
        inside = F.col(key).isNull() | (F.pmod(F.xxhash64(F.lit(2), key), F.lit(slices)) == 0)
        rows, named = rows.where(inside), named.where(inside)
    suspects = rows_outside(rows, key_filter(named, key, blocks), key, blocks).take(1)
    if suspects and suspects[0][key] is not None:
        require(named.where(F.col(key) == suspects[0][key]).isEmpty(), f"the filter lost {key} {suspects[0][key]}")
    return suspects[0] if suspects else None


def has_unknown(rows: DataFrame, parts: DataFrame, key: str = "part_id") -> bool:
    """Whether any row has a key that is no part: the probe first, the exact anti join if it meets none."""
    return first_unknown(rows, parts, key) is not None or not unknown_parts(rows, parts, key).isEmpty()


def parts_without(parts: DataFrame, visits: DataFrame) -> DataFrame:
    """Parts that have no visit at all (anti join on the distinct visited parts)."""
    return parts.join(visits.select("part_id").distinct(), "part_id", "left_anti")


def invalid_time_order(visits: DataFrame) -> DataFrame:
    """Visits whose bounds are swapped; a missing bound is no violation."""
    return visits.where(F.col("first_observed_time") > F.col("last_observed_time"))


def one_to_one(left: DataFrame, right: DataFrame, key: str = ID, aligned: bool = False) -> DataFrame:
    """Inner join that fails, when it is computed, if a key is repeated on either side.

    With ``aligned`` a key that is NULL or on one side only fails as well. Each side is scanned, moved and
    sorted once: repeats are neighbours in the sorted rows of the join, and the first one met ends it,
    so no repeated key can multiply rows.
    """

    def fail(message: str):
        return F.raise_error(F.lit(message)).cast("boolean")

    def numbered(df: DataFrame, side: str) -> DataFrame:
        again = F.row_number().over(Window.partitionBy(key).orderBy(key))
        return df.hint("merge").withColumn(side, again)

    both = numbered(left, "_left_row").join(numbered(right, "_right_row"), key, "full_outer")
    matched = F.col("_left_row").isNotNull() & F.col("_right_row").isNotNull()
    repeated = (F.col("_left_row") > 1) | (F.col("_right_row") > 1)
    kept = F.when(repeated, fail(f"{key} is repeated, the sides cannot be merged one to one"))
    if aligned:
        kept = kept.when(~matched, fail(f"{key} differs between the sides"))
    return both.where(kept.otherwise(matched)).drop("_left_row", "_right_row")


# --- checks that act: they run a job and raise ------------------------------------------------


def require(holds: bool, message: str) -> None:
    if not holds:
        raise GateError(message)


def require_none(violations: DataFrame, message: str) -> None:
    """Existence probe: stops at the first violation."""
    require(violations.limit(1).isEmpty(), message)


def require_known(rows: DataFrame, parts: DataFrame, message: str, key: str = "part_id") -> None:
    """Every key of ``rows`` is a part: the early-stopping probe first, then the exact anti join."""
    found = first_unknown(rows, parts, key)
    require(found is None, f"{message}, for instance {key} {found and found[key]}")
    require_none(unknown_parts(rows, parts, key), message)


def require_keys(df: DataFrame, keys: Sequence[str], what: str) -> int:
    """No NULL and no repeated key; returns the row count."""
    report = key_report(df, keys).first()
    require(report["null_keys"] == 0, f"{what}: {report['null_keys']:,} rows without {', '.join(keys)}")
    require(report["duplicate_keys"] == 0, f"{what}: {report['duplicate_keys']:,} repeated {', '.join(keys)}")
    return report["rows"]


def require_columns(
    df: DataFrame, what: str, required: Sequence[str] = (), allowed: dict[str, Sequence] | None = None
) -> None:
    report = column_violations(df, required, allowed).first().asDict()
    broken = {check: n for check, n in report.items() if n}
    require(not broken, f"{what}: {broken}")


def require_rows(actual: int, expected: int | None, what: str) -> None:
    require(expected is None or actual == expected, f"{what}: expected {expected} rows, found {actual}")


def require_aligned(left: DataFrame, right: DataFrame, key: str = ID) -> int:
    """Both sources hold the same ids exactly once; returns how many."""
    report = source_alignment(left, right, key).first()
    require(report["aligned"], f"sources differ: {report.asDict()}")
    return report["matched_ids"]




__all__ = [
    "as_rows",
    "column_violations",
    "first_unknown",
    "has_unknown",
    "id_balance",
    "invalid_time_order",
    "key_counts",
    "key_filter",
    "key_report",
    "one_to_one",
    "parts_without",
    "require",
    "require_aligned",
    "require_columns",
    "require_keys",
    "require_known",
    "require_none",
    "require_rows",
    "rows_outside",
    "source_alignment",
    "unknown_parts",
]
