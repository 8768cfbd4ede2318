"""Embedding whitening: the leading principal components by a block Jacobi-Davidson method.

The covariance is never formed. It acts on a few vectors at a time through one pass over the distinct
vectors: every task centres its rows, multiplies them, and sends back sums of the size of the answer.
The driver keeps a small subspace. Rayleigh-Ritz picks the best vectors in it; those whose residual has
reached double precision are locked; for the others the projected correction equation is solved
roughly by inner MINRES, all of them sharing each pass, and the corrections widen the subspace.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import map_arrow, written

SCALE = 256
LARGEST = float(1 << 53)  # scaled entries are exact integers below
COMPONENTS = 4
EXTRA = 4  # vectors at the start beyond the wanted ones
INNER_STEPS = 4
MOST_ROUNDS = 200
MOST_COLUMNS = 96  # of the subspace, before it restarts from its best vectors
RESIDUAL = 64 * np.finfo(np.float64).eps  # of the largest eigenvalue: double precision
BLOCK_ROWS = 4096
SEED = 5

OUT = (
    "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column as rows of 64-bit integers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def scaled(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): ``floor(256 * c)`` of every entry, of rows whose entries are all there and finite."""
    embedding = F.col("embedding").cast("array<double>")
    wide = F.transform(embedding, lambda c: c * F.lit(float(SCALE)))
    broken = F.exists(wide, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= F.lit(LARGEST)))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), wide.alias("wide"), broken.alias("broken"))
    sound = rows.where(F.col("wide").isNotNull() & ~F.col("broken"))
    return sound.select("vec_id", F.transform("wide", lambda c: F.floor(c).cast("bigint")).alias("x"))


@dataclass(frozen=True)
class FitList:
    """The distinct vectors as written blocks of 64-bit integers, with their exact sums."""

    blocks: DataFrame  # data binary
    dim: int
    n: int
    sums: tuple[int, ...]
    largest: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def summed(self, partial: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
        """Sum over all blocks of ``partial`` of the centred rows, an array of ``shape``.

        Each task adds up its own blocks. What the tasks send is added in a fixed order, so a run that
        is repeated gives the same digits.
        """
        dim, mean = self.dim, self.mean

        def run(batches):
            held = np.zeros(shape)
            for batch in batches:
                for data in batch.column(0):
                    rows = np.frombuffer(data.as_buffer(), np.int64).reshape(-1, dim)
                    held += partial(rows - mean)
            yield [pa.array(np.arange(held.size, dtype=np.int32)), pa.array(held.ravel())]

        parts = map_arrow(self.blocks, run, StructType.fromDDL("cell int, value double"))
        ordered = F.aggregate(F.sort_array(F.collect_list("value")), F.lit(0.0), lambda a, v: a + v)
        found = parts.groupBy("cell").agg(ordered.alias("value")).collect()
        out = np.zeros(shape[0] * shape[1])
        out[[r["cell"] for r in found]] = [r["value"] for r in found]
        return out.reshape(shape)

    def product(self, vectors: np.ndarray) -> np.ndarray:
        """The covariance times the columns of ``vectors``: one pass."""
        return self.summed(lambda y: y.T @ (y @ vectors), vectors.shape) / self.n

    def trace(self) -> float:
        return float(self.summed(lambda y: np.full((1, 1), (y * y).sum()), (1, 1))[0, 0]) / self.n


def fit_list(rows: DataFrame, dim: int) -> FitList:
    """Distinct ``x`` of ``rows``; a vector that many rows share is combined before the shuffle."""
    schema = StructType.fromDDL("data binary, rows bigint, largest bigint, highs array<bigint>, lows array<bigint>")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                x = matrix(batch.column(0).slice(at, BLOCK_ROWS), dim)
                # Two halves of every number, so that no sum leaves 64 bits.
                halves = [(x >> 26).sum(axis=0).tolist(), (x & ((1 << 26) - 1)).sum(axis=0).tolist()]
                yield [
                    pa.array([x.tobytes()], pa.binary()),
                    pa.array([len(x)], pa.int64()),
                    pa.array([int(np.abs(x).max(initial=0))], pa.int64()),
                    *[pa.array([h], pa.list_(pa.int64())) for h in halves],
                ]

    blocks = written(map_arrow(rows.select("x").distinct().sortWithinPartitions("x"), run, schema), "whitening-fit")
    totals = blocks.agg(F.sum("rows"), F.max("largest")).first()
    dims = blocks.select(F.posexplode(F.arrays_zip("highs", "lows")).alias("i", "half"))
    sums = dims.groupBy("i").agg(F.sum("half.highs").alias("high"), F.sum("half.lows").alias("low")).orderBy("i").collect()
    return FitList(blocks.select("data"), dim, totals[0] or 0, tuple((r["high"] << 26) + r["low"] for r in sums), totals[1] or 0)


def expanded(basis: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span what ``vectors`` add to ``basis``."""
    new: list[np.ndarray] = []
    for v in vectors.T:
        size = np.linalg.norm(v)
        if not size:
            continue
        v, before = v / size, 1.0
        for _ in range(3):
            v = v - basis @ (basis.T @ v)
            for u in new:
                v = v - u * (u @ v)
            before, size = size, np.linalg.norm(v)
        if size > 1e-8:
            new.append(v / size)
    return np.stack(new, axis=1) if new else np.zeros((len(basis), 0))


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(np.broadcast(a, b).shape), where=b != 0)


def corrections(
    product: Callable[[np.ndarray], np.ndarray], ritz: np.ndarray, values: np.ndarray, residuals: np.ndarray, steps: int
) -> np.ndarray:
    """Rough solutions t of (I - QQ')(A - value)(I - QQ') t = -residual, one column each, where Q is ``ritz``.

    MINRES on every column side by side; a step costs one product for all of them.
    """

    def project(v):
        return v - ritz @ (ritz.T @ v)

    now = project(-residuals)
    beta = np.linalg.norm(now, axis=0)
    now, eta = ratio(now, beta), beta.copy()
    old, beta = np.zeros_like(now), np.zeros_like(beta)
    cos, sin, cos_old, sin_old = np.ones_like(beta), np.zeros_like(beta), np.ones_like(beta), np.zeros_like(beta)
    way, way_old, solution = np.zeros_like(now), np.zeros_like(now), np.zeros_like(now)
    for _ in range(steps):
        inside = project(now)
        image = project(product(inside) - inside * values)
        alpha = (now * image).sum(axis=0)
        image = image - alpha * now - beta * old
        beta_new = np.linalg.norm(image, axis=0)
        head = cos * alpha - cos_old * sin * beta
        first, second, third = np.hypot(head, beta_new), sin * alpha + cos_old * cos * beta, sin_old * beta
        cos_old, sin_old, cos, sin = cos, sin, ratio(head, first), ratio(beta_new, first)
        way, way_old = ratio(now - second * way - third * way_old, first), way
        solution = solution + cos * eta * way
        eta = -sin * eta
        old, now, beta = now, ratio(image, beta_new), beta_new
    return solution


def leading_pairs(product: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of the ``wanted`` largest eigenpairs of a symmetric ``product``, falling.

    All residuals end at :data:`RESIDUAL` of the largest value, checked against products of their own.
    """
    rng = np.random.default_rng(SEED)
    basis = expanded(np.zeros((dim, 0)), rng.standard_normal((dim, min(dim, wanted + EXTRA))))
    image = product(basis)
    for _ in range(MOST_ROUNDS):
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, moved = basis @ turn[:, :wanted], image @ turn[:, :wanted]
        residuals = moved - ritz * values[:wanted]
        limit = RESIDUAL * max(abs(values[0]), np.finfo(np.float64).tiny)
        waiting = np.flatnonzero(np.linalg.norm(residuals, axis=0) > limit)
        if not len(waiting):
            moved = product(ritz)
            residuals = moved - ritz * values[:wanted]
            waiting = np.flatnonzero(np.linalg.norm(residuals, axis=0) > 4 * limit)
        if not len(waiting) or basis.shape[1] == dim:
            break
        if basis.shape[1] + len(waiting) > max(MOST_COLUMNS, 3 * wanted):
            best = turn[:, : wanted + EXTRA]
            basis, image = basis @ best, image @ best
        found = corrections(product, ritz, values[waiting], residuals[:, waiting], INNER_STEPS)
        new = expanded(basis, found)
        if not new.shape[1]:
            new = expanded(basis, rng.standard_normal((dim, len(waiting))))
        basis, image = np.concatenate([basis, new], axis=1), np.concatenate([image, product(new)], axis=1)
    else:
        raise ArithmeticError("the components did not reach double precision")
    ritz = ritz / np.linalg.norm(ritz, axis=0)
    sign = np.sign(ritz[np.abs(ritz).argmax(axis=0), np.arange(ritz.shape[1])])
    return values[:wanted].copy(), ritz * sign


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...], largest: int) -> list[int | None]:
    """Exact sums over dimensions of (n * x - S)^2, where no |x| exceeds ``largest``; None beyond 64 bits."""
    reach = 2 * n * largest
    if len(sums) * reach * reach < 1 << 63:
        off = n * x - np.array(sums, np.int64)
        return (off * off).sum(axis=1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [d if d < 1 << 63 else None for d in exact]


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of ``vectors`` (vec_id, embedding).

    Vectors that are null or hold null or non-finite entries, or entries of 2^45 or more, have no rows;
    nor have vectors of another length than most (of equally frequent lengths, the longer), and empty
    ones. Rows that repeat a vector or an id, or have a null id, are each projected, while the fit counts
    a vector once. A component whose variance is zero within double precision is left out: one distinct
    vector, or none, gives an empty result. ``deviation`` is null where 64 bits cannot hold it. The sign of
    a component makes its largest coordinate positive. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = written(scaled(vectors), "whitening-rows")
    sizes = rows.groupBy(F.size("x").alias("dim")).count().where("dim > 0").orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], OUT)
    dim = sizes[0]["dim"]
    rows = rows.where(F.size("x") == dim)
    fit = fit_list(rows, dim)
    trace = fit.trace()
    values, axes = leading_pairs(fit.product, dim, min(components, dim)) if trace else (np.zeros(0), np.zeros((dim, 0)))
    spread = values > dim * np.finfo(np.float64).eps * trace
    values, axes = values[spread], axes[:, spread]
    if not len(values):
        return spark.createDataFrame([], OUT)
    mean, turn, count = fit.mean, axes / np.sqrt(values), len(values)
    n, sums, largest = fit.n, fit.sums, fit.largest
    moments = fit.summed(
        lambda y: np.concatenate([(y @ turn).T @ (y @ turn), (y @ turn).sum(axis=0)[None, :]]), (count + 1, count)
    ) / fit.n
    covariance = moments[:count] - np.outer(moments[count], moments[count])
    error = float(np.abs(covariance - np.eye(count)).max())
    explained = values / trace

    def run(batches):
        for batch in batches:
            x = matrix(batch.column(1), dim)
            if not len(x):
                continue
            whitened = (x - mean) @ turn
            each = np.repeat(np.arange(len(x)), count)
            deviation = pa.array(deviations(x, n, sums, largest), pa.int64())
            yield [
                batch.column(0).take(pa.array(each)),
                pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(each), n)),
                deviation.take(pa.array(each)),
                pa.array(whitened.ravel()),
                pa.array(np.tile(explained, len(x))),
                pa.array(np.full(len(each), error)),
            ]

    return map_arrow(rows, run, StructType.fromDDL(OUT))
