"""Exact equal-sized tiles over a global order, without ordering or moving all rows.

Tiles need only the first row of each of them, and those border rows are selected exactly. A quantile
sketch gives every border a narrow bracket of values of the first order column. Rows are counted by
bracket; only inside the brackets are values told apart, and a value that many rows share is split by
cells of the second column. The running count names the few groups that hold a border, and a border is a
position in its group. Every row is then compared with the borders. All of it is one lazy plan; nothing
is written.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

GRID = 500  # cells of the quantile sketch
FEW = 32  # borders that are compared one by one
ACCURACY = 20 * GRID  # so that the sketch errs by a twentieth of a cell
SKETCHED = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)


def global_row_index(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Adds ``row_index`` (0-based rank in the order, NULLs last) and ``row_total``.

    Rows are range-partitioned on all order columns, so a value shared by many rows is split by
    the columns after it. Range bounds are sampled and differ between runs; the ordered rows are
    therefore written once to the shared folder, and both the partition sizes and the result are
    read from that table. Order columns must identify a row for the index to be unique per row.
    """
    order = [F.col(name).asc_nulls_last() for name in order_by]
    path = scratch_path(df.sparkSession, "ordered")
    # The id is (partition << 33) + position within the sorted partition.
    df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "_slot", F.monotonically_increasing_id()
    ).write.parquet(path)
    ordered = df.sparkSession.read.parquet(path).withColumn("_part", F.shiftright("_slot", 33))

    # One row per range partition: the only place where a single task sees "everything".
    sizes = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = sizes.select(
        "_part",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"),
        F.sum("n").over(everything).alias("row_total"),
    )
    position = F.col("_slot").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        ordered.join(F.broadcast(offsets), "_part")
        .withColumn("row_index", F.col("_before") + position)
        .select(*df.columns, "row_index", "row_total")
    )


def tile_of(index: str, total: str, tiles: int):
    """1-based tile of a 0-based index; the first ``total mod tiles`` tiles hold one row more."""
    return F.expr(
        f"""CAST(CASE WHEN {index} < ({total} % {tiles}) * ({total} DIV {tiles} + 1)
                 THEN {index} DIV ({total} DIV {tiles} + 1)
                 ELSE {total} % {tiles}
                      + ({index} - ({total} % {tiles}) * ({total} DIV {tiles} + 1))
                        DIV greatest({total} DIV {tiles}, 1L)
            END + 1 AS INT)"""
    )


def _rank_key(value: Column) -> Column:
    """A value so that comparisons put NULL last; a key of (false, NULL) comes before all others."""
    return F.struct(value.isNull().alias("missing"), value.alias("value"))


def _count_while(bounds: Column, most: int, holds) -> Column:
    """How many leading entries of the sorted array ``bounds``, of at most ``most``, satisfy ``holds``.

    Few entries are compared one by one in generated code, many by halving.
    """
    if most <= FEW:
        compared = [F.when(F.coalesce(holds(F.get(bounds, F.lit(i))), F.lit(False)), 1).otherwise(0) for i in range(most)]
        return reduce(lambda a, b: a + b, compared, F.lit(0))
    steps = [1 << i for i in reversed(range(most.bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(step) for step in steps]),
        F.lit(0),
        lambda i, step: F.when(F.coalesce(holds(F.get(bounds, i + step - 1)), F.lit(False)), i + step).otherwise(i),
    )


def _grid(name: str, kind: T.DataType) -> tuple[Column, Column]:
    """Quantile grid of one column, and how many rows it describes (neither NULL nor NaN)."""
    told = f"nullif({name}, double('NaN'))" if isinstance(kind, (T.DoubleType, T.FloatType)) else name
    # One constant: hundreds of literals would be carried through every step of planning.
    fractions = f"CAST(split('{' '.join(str(i / GRID) for i in range(GRID + 1))}', ' ') AS array<double>)"
    return F.expr(f"percentile_approx({told}, {fractions}, {ACCURACY})"), F.expr(f"count({told})")


def _brackets() -> list[Column]:
    """Lowest and highest key that the rows at ``starts`` can have, by the sketch beside them.

    The row at r lies in cell ``floor(r * GRID / told)``; a bracket adds one cell on either side.
    """
    cell = f"CAST(floor(r * {GRID}L / greatest(told, 1L)) AS INT)"
    low = f"named_struct('missing', false, 'value', IF({cell} < 1, NULL, get(grid, least({cell}, {GRID}) - 1)))"
    high = (
        f"IF(r >= told OR {cell} + 2 > {GRID}, named_struct('missing', true, 'value', get(grid, -1)), "
        f"named_struct('missing', false, 'value', get(grid, {cell} + 2)))"
    )
    return [F.expr(f"transform(starts, r -> {low})").alias("lows"), F.expr(f"transform(starts, r -> {high})").alias("highs")]


def tile_borders(df: DataFrame, tiles: int, order_by: Sequence[str]) -> DataFrame:
    """One row, ``borders``: the sorted keys of the first rows of tiles 2, 3, ... in the global order.

    One or two order columns. A key is one ``missing, value`` pair for each. Shuffles move sketches,
    counts per bracket, the distinct values inside brackets, about 0.6 % of the rows for each border, and
    the rows of the groups that hold a border, at most 0.2 % each if the columns identify a row.
    """
    names = [f"_k{i}" for i in range(len(order_by))]
    keys = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(order_by, names, strict=True)])
    # All rows are one group. Its key must not be a constant, or its small tables would be joined without one.
    keys = keys.withColumn("_all", F.pmod(F.xxhash64(names[0]), F.lit(1)))
    grids = [_grid(n, df.schema[c].dataType) for c, n in zip(order_by, names, strict=True)]
    second = grids[1][0] if len(names) > 1 else F.lit(None).cast("array<double>")
    sketch = keys.groupBy("_all").agg(
        grids[0][0].alias("grid"), grids[0][1].alias("told"), F.count(F.lit(1)).alias("rows"), second.alias("second")
    )
    starts = F.expr(
        f"filter(transform(sequence(1L, {tiles - 1}L), b -> b * (rows div {tiles}) + least(b, rows % {tiles})), r -> r < rows)"
    )
    known = sketch.withColumn("starts", starts).select("_all", "starts", "second", *_brackets())

    def cell() -> Column:
        if len(names) == 1:
            return F.lit(0)
        passed = _count_while(F.col("second"), GRID + 1, lambda bound: bound <= F.col("_k1"))
        return F.when(F.col("_k1").isNull(), F.lit(GRID + 2)).otherwise(passed)

    # A row that has passed some brackets lies inside the next one or below it; rows below are only counted.
    placed = keys.join(F.broadcast(known), "_all").withColumn("key", _rank_key(F.col("_k0")))
    placed = placed.withColumn("passed", _count_while(F.col("highs"), tiles - 1, lambda high: high < F.col("key")))
    inside = F.coalesce(F.get("lows", F.col("passed")) <= F.col("key"), F.lit(False))
    counts = (
        placed.select("_all", "passed", F.when(inside, F.col("key")).alias("key"), F.when(inside, cell()).alias("cell"))
        .groupBy("_all", "passed", "key", "cell")
        .agg(F.count(F.lit(1)).alias("n"))
        .repartition("passed")
    )
    held = counts.groupBy("_all", "passed").agg(F.sum("n").alias("held"))
    ahead = Window.partitionBy("_all").orderBy("passed").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select("_all", "passed", F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("offset"))
    offsets = offsets.join(F.broadcast(known.select("_all", "starts", "second")), "_all")
    within = Window.partitionBy("passed").orderBy(F.col("key").asc_nulls_first(), "cell")
    counted = counts.withColumn("within", F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    found = counted.join(F.broadcast(offsets.drop("_all")), "passed").withColumn("before", F.col("offset") + F.col("within"))
    mine = F.expr("transform(filter(starts, r -> r >= before AND r < before + n), r -> r - before)")
    groups = found.select("key", "cell", "second", mine.alias("positions")).where(F.size("positions") > 0)
    if len(names) == 1:
        each = groups.select(F.struct(F.col("key").alias("_k0_key")).alias("border"), F.explode("positions"))
    else:
        near = groups.withColumnRenamed("cell", "_cell")
        tied = keys.join(F.broadcast(near), F.col("_k0").eqNullSafe(F.col("key.value"))).where(cell() == F.col("_cell"))
        order = Window.partitionBy("key", "_cell").orderBy(F.col("_k1").asc_nulls_last())
        at = tied.withColumn("at", F.row_number().over(order).cast("bigint") - 1).where(F.array_contains("positions", F.col("at")))
        each = at.select(F.struct(F.col("key").alias("_k0_key"), _rank_key(F.col("_k1")).alias("_k1_key")).alias("border"))
    borders = each.agg(F.sort_array(F.collect_list("border")).alias("borders"))
    # The sketch errs by less than a bracket allows; should it ever not, the result fails.
    wanted = F.coalesce(known.select(F.size("starts")).scalar(), F.lit(0))
    missed = F.raise_error(F.lit("a tile border lies outside its bracket"))
    return borders.select(F.when(F.size("borders") == wanted, F.col("borders")).otherwise(missed).alias("borders"))


def global_ntile(df: DataFrame, tiles: int, order_by: Sequence[str], out: str = "tile") -> DataFrame:
    """``ntile(tiles) OVER (ORDER BY ...)`` for data of any size, NULLs last.

    The order columns should identify a row: rows that are equal in all of them share a tile. More than
    two columns, or such as no quantile sketch can hold, like text, go through :func:`global_row_index`.
    """
    if tiles < 1:
        raise ValueError("tiles must be positive")
    if len(order_by) > 2 or not all(isinstance(df.schema[c].dataType, SKETCHED) for c in order_by):
        indexed = global_row_index(df, order_by)
        return indexed.withColumn(out, tile_of("row_index", "row_total", tiles)).drop("row_index", "row_total")
    if tiles == 1:
        return df.withColumn(out, F.lit(1))
    borders = tile_borders(df, tiles, order_by).scalar().alias("_borders")
    key = F.struct(*[_rank_key(F.col(f"`{c}`")).alias(f"_k{i}_key") for i, c in enumerate(order_by)])
    tile = _count_while(F.col("_borders"), tiles - 1, lambda border: border <= key) + 1
    return df.select("*", borders).withColumn(out, tile).drop("_borders")
