"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample and small; every vector is then assigned to its leaf. A query
walks the tree with a priority queue, nearest centre first, and visits leaves in that order. How many
leaves it visits is calibrated: a bounded set of queries is compared with all vectors by brute force,
and visits widen until their recall is reached. Distances are exact, in double precision.

Equal vectors are one class, of which only the smallest ids can ever be among the nearest, so a
vector that a third of all rows share costs as much as a rare one.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import ship, written

SAMPLE_ROWS = 20_000
BRANCH = 16
LEAF_SAMPLE = 100
ROUNDS = 8
CALIBRATION_QUERIES = 200
TARGET_RECALL = 0.97
CHUNK_ROWS = 20_000
CHUNK_QUERIES = 2_000
SEED = 7
FOUND = "query_id bigint, vec_id bigint, score double"


@dataclass
class Node:
    centers: np.ndarray | None = None
    children: list[Node] = field(default_factory=list)
    leaf: int = -1


class Tree:
    """Hierarchical k-means over a sample; leaves are numbered."""

    def __init__(self, sample: np.ndarray, branch: int = BRANCH, leaf_sample: int = LEAF_SAMPLE, seed: int = SEED):
        self.rng = np.random.default_rng(seed)
        self.leaves = 0
        self.root = self._grow(np.asarray(sample, np.float64), branch, leaf_sample)

    def _grow(self, rows: np.ndarray, branch: int, leaf_sample: int) -> Node:
        unique = np.unique(rows, axis=0) if len(rows) <= branch * leaf_sample else rows
        if len(rows) <= leaf_sample or len(unique) <= 1:
            self.leaves += 1
            return Node(leaf=self.leaves - 1)
        centers = rows[self.rng.choice(len(rows), min(branch, len(rows)), replace=False)]
        centers = np.unique(centers, axis=0)
        for _ in range(ROUNDS):
            owner = nearest_center(rows, centers)
            present = np.unique(owner)
            centers = np.stack([rows[owner == c].mean(axis=0) for c in present])
        owner = nearest_center(rows, centers)
        present = np.unique(owner)
        if len(present) < 2:
            self.leaves += 1
            return Node(leaf=self.leaves - 1)
        return Node(centers[present], [self._grow(rows[owner == c], branch, leaf_sample) for c in present])

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """Leaf of each row, by the nearest centre at every level."""
        out = np.zeros(len(rows), np.int64)
        stack = [(self.root, np.arange(len(rows)))]
        while stack:
            node, at = stack.pop()
            if node.leaf >= 0:
                out[at] = node.leaf
                continue
            owner = nearest_center(rows[at], node.centers)
            stack += [(child, at[owner == c]) for c, child in enumerate(node.children) if (owner == c).any()]
        return out

    def visits(self, query: np.ndarray, most: int, sizes: dict[int, int] | None = None, least: int = 0) -> list[int]:
        """The first ``most`` leaves best bin first: the queue always yields the nearest centre seen.

        With ``sizes`` of leaves, as many more as hold ``least`` rows together, or all leaves.
        """
        queue, serial, out, held = [(0.0, 0, self.root)], 0, [], 0
        while queue and (len(out) < most or (sizes is not None and held < least)):
            _, _, node = heapq.heappop(queue)
            while node.leaf < 0:
                far = ((node.centers - query) ** 2).sum(axis=1)
                best = int(far.argmin())
                for c, child in enumerate(node.children):
                    if c != best:
                        serial += 1
                        heapq.heappush(queue, (float(far[c]), serial, child))
                node = node.children[best]
            out.append(node.leaf)
            held += sizes.get(node.leaf, 0) if sizes else 0
        return out


def nearest_center(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Index of the nearest centre; a row's result does not depend on the rows beside it."""
    half = (centers**2).sum(axis=1) / 2
    out = np.empty(len(rows), np.int64)
    for at in range(0, len(rows), 4096):
        part = rows[at : at + 4096]
        out[at : at + 4096] = (half - np.einsum("ij,kj->ik", part, centers)).argmin(axis=1)
    return out


def matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.empty((0, dim))


def nearest_rows(ids: np.ndarray, rows: np.ndarray, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of the ``k`` rows nearest to a query, its own id aside; ties to smaller ids."""
    far = np.sqrt(((rows - query) ** 2).sum(axis=1))
    other = ids != query_id
    ids, far = ids[other], far[other]
    if len(ids) > k:
        few = far <= np.partition(far, k - 1)[k - 1]
        ids, far = ids[few], far[few]
    order = np.lexsort((ids, far))[:k]
    return ids[order], far[order]


def usable(embedding: Column) -> Column:
    """Whether a vector is there, not zero, and holds finite numbers only."""
    broken = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(embedding.isNotNull() & ~broken & F.exists(embedding, lambda x: x != 0), F.lit(False))


def best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each query, ranked; partial lists are cut before they are shuffled."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def brute_force(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Exact neighbours of a few ``queries``, which go to every task, among all ``rows``."""
    few = queries.select("vec_id", "embedding").collect()
    ids = [r["vec_id"] for r in few]
    points = [np.array(r["embedding"], np.float64) for r in few]
    ship(rows.sparkSession)

    def run(frames):
        for frame in frames:
            if not len(frame):
                continue
            have, own = matrix(frame["embedding"], 0), frame["vec_id"].to_numpy()
            for query_id, point in zip(ids, points, strict=True):
                near, far = nearest_rows(own, have, query_id, point, k)
                yield pd.DataFrame({"query_id": query_id, "vec_id": near, "score": far})

    return best(rows.select("vec_id", "embedding").mapInPandas(run, FOUND), k)


def calibrated_visits(tree: Tree, queries: DataFrame, rows: DataFrame, k: int, target: float, most: int) -> int:
    """The fewest leaf visits at which a bounded set of queries finds ``target`` of its true neighbours."""
    total = queries.count()
    chance = F.pmod(F.xxhash64(F.lit("calibrate"), "vec_id"), F.lit(1 << 20))
    few = queries.where(chance <= F.lit(int((1 << 20) * min(1.0, 1.5 * most / max(total, 1))))).orderBy(chance, "vec_id").limit(most)
    few = written(few, "ann-calibration")
    truth = brute_force(few, rows, k).join(rows.select("vec_id", "leaf"), "vec_id").select("query_id", "leaf").collect()
    points = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in few.collect()}
    place = {q: {leaf: i + 1 for i, leaf in enumerate(tree.visits(p, tree.leaves))} for q, p in points.items()}
    needed = sorted(place[r["query_id"]][r["leaf"]] for r in truth)
    return needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)] if needed else 1


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    sample_rows: int = SAMPLE_ROWS,
    target: float = TARGET_RECALL,
    calibration: int = CALIBRATION_QUERIES,
    chunk_rows: int = CHUNK_ROWS,
    chunk_queries: int = CHUNK_QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): ``k`` neighbours of each row of ``vectors`` with ``is_query``.

    ``vectors`` has vec_id and embedding. Candidates are all rows but those with the query's own id;
    ``score`` is the Euclidean distance of the original vectors in double precision, ties go to the
    smaller id. Rows whose id is null, and vectors that are null, zero or hold null or non-finite
    components take no part, nor do vectors of another length than most (of equally frequent lengths,
    the longer). Rows that repeat both id and vector count once. A query visits the calibrated number of
    leaves, and more until they hold ``k`` candidates; one with fewer candidates gets them all. No vectors or no queries give an empty result.
    """
    spark = vectors.sparkSession
    ship(spark)
    marked = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.coalesce(is_query, F.lit(False)).alias("is_query"),
    )
    sound = marked.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = written(sound, "ann-rows")
    sizes = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim, total = sizes[0]["dim"], sizes[0]["count"]
    rows = rows.where(F.size("embedding") == dim)
    same = Window.partitionBy("embedding").orderBy("vec_id")
    classes = rows.select("vec_id", "embedding").distinct().withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1)

    chance = F.pmod(F.xxhash64(F.lit("sample"), "vec_id"), F.lit(1 << 20))
    part = rows.where(chance <= F.lit(int((1 << 20) * min(1.0, sample_rows / total))))
    drawn = part.select("vec_id", "embedding").distinct().orderBy("vec_id").limit(2 * sample_rows).collect()
    tree = Tree(np.array([r["embedding"] for r in drawn], np.float64).reshape(-1, dim))

    def place(frames):
        for frame in frames:
            yield frame.assign(leaf=tree.assign(matrix(frame["embedding"], dim)))

    leaves = "vec_id bigint, embedding array<double>, leaf bigint"
    indexed = written(classes.select("vec_id", "embedding").mapInPandas(place, leaves), "ann-index")
    queries = rows.where("is_query").select("vec_id", "embedding").distinct()
    most = calibrated_visits(tree, queries, indexed, k, target, calibration)

    # An id counts in one leaf only, so k + 1 ids in the visited leaves are k candidates beside the query. At most one
    # row a leaf, and the tree has no more leaves than sampled rows.
    once = indexed.groupBy("vec_id").agg(F.min("leaf").alias("leaf"))
    sizes = {r["leaf"]: r["count"] for r in once.groupBy("leaf").count().collect()}

    def walk(frames):
        for frame in frames:
            visits = [tree.visits(np.asarray(v, np.float64), most, sizes, k + 1) for v in frame["embedding"]]
            yield frame.assign(leaf=visits).explode("leaf").astype({"leaf": "int64"})

    # Both sides of a leaf are dealt out in chunks, and every chunk of one meets every chunk of the other.
    bound = written(queries.mapInPandas(walk, leaves), "ann-visits")
    counts = indexed.groupBy("leaf").agg(F.ceil(F.count("*") / chunk_rows).cast("bigint").alias("parts"))
    asked = bound.groupBy("leaf").agg(F.ceil(F.count("*") / chunk_queries).cast("bigint").alias("shares"))
    grid = counts.join(asked, "leaf")
    own = indexed.join(grid, "leaf").withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts"))
    own = own.withColumn("share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shares") - 1)))
    ask = bound.join(grid, "leaf").withColumn("share", F.pmod(F.xxhash64("vec_id"), "shares"))
    ask = ask.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    keys = ["leaf", "part", "share"]

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        have, ids = matrix(left["embedding"], dim), left["vec_id"].to_numpy()
        out = []
        for query_id, point in zip(right["vec_id"], right["embedding"], strict=True):
            near, far = nearest_rows(ids, have, query_id, np.asarray(point, np.float64), k)
            out.append(pd.DataFrame({"query_id": query_id, "vec_id": near, "score": far}))
        return pd.concat(out) if out and len(left) else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    columns = [*keys, "vec_id", "embedding"]
    met = own.select(*columns).groupBy(*keys).cogroup(ask.select(*columns).groupBy(*keys)).applyInPandas(search, FOUND)
    return best(met, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def recall(found: DataFrame, truth: DataFrame) -> float:
    """Share of the true neighbours (query_id, vec_id) that were found."""
    pairs = ["query_id", "vec_id"]
    hit = truth.select(*pairs).join(found.select(*pairs), pairs, "left_semi").count()
    return hit / max(1, truth.count())
