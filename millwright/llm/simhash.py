"""SimHash near-duplicates: pigeonhole blocks, joined on blocks, verified by Hamming distance.

The unit of work is a distinct fingerprint, so exact copies, however many, cost one row. Blocks of a
fingerprint are chosen so that any two fingerprints within the distance agree on one whole key;
every key is sorted, and a run of equal keys yields only the links of a spanning forest, never all
pairs of a group. Links become components with alternating star steps on written tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .components import connected_components
from .shared import map_arrow, with_columns, without_columns, written

SEED = 42
BITS = 64
ROWS_AT_ONCE = 1 << 16
LINKS = StructType([StructField("a", LongType()), StructField("b", LongType())])


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """SimHash of the lower-cased (A-Z) words of a text; zero if it has none.

    Shingles are ``shingle`` words joined by spaces, repeats included; a shorter text is one shingle.
    A bit is set if more than half of the shingle hashes (XXH64, seed 42) have it.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.empty_like(ends)
    starts[0] = 0
    starts[1:] = ends[:-1] + 1
    n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    hashes = np.fromiter((digest(flat[a:b], SEED) for a, b in spans), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, ROWS_AT_ONCE):
        part = hashes[at : at + ROWS_AT_ONCE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def block_masks(blocks: int, max_distance: int, bits: int = BITS) -> list[int]:
    """Masks of every choice of ``blocks - max_distance`` blocks.

    ``max_distance`` differing bits touch at most as many blocks, so two close fingerprints agree on
    all bits of at least one mask.
    """
    edges = [bits * i // blocks for i in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(block, blocks - max_distance)]


def blocks_for(rows: int, max_distance: int) -> int:
    """The fewest blocks whose keys are wide enough that ``rows`` random fingerprints seldom share one."""
    for blocks in range(max_distance + 2, max_distance + 6):
        if 2 ** (BITS * (blocks - max_distance) // blocks) >= 4 * rows or comb(blocks, max_distance) > 100:
            return blocks
    return max_distance + 5


def forest(points: np.ndarray, max_distance: int) -> list[tuple[int, int]]:
    """Links that span every component of distinct fingerprints within ``max_distance`` bits."""
    links: list[tuple[int, int]] = []
    if len(points) == 2:
        a, b = points.tolist()
        return [(a, b)] if (a ^ b).bit_count() <= max_distance else []
    left = points
    while left.size > 1:
        reached, left = [left[0]], left[1:]
        while reached and left.size:
            at = reached.pop()
            near = np.bitwise_count(left ^ at) <= max_distance
            if near.any():
                found = left[near]
                links.extend((int(at), x) for x in found.tolist())
                reached.extend(found)
                left = left[~near]
    return links


def run_links(batches: Iterator[pa.RecordBatch], max_distance: int) -> Iterator[list[pa.Array]]:
    """Links inside each run of equal (mask, key) rows; a run may cross batches."""
    held: list[np.ndarray] = []
    last = None

    def out(links):
        pairs = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
        low, high = pairs.min(axis=1, initial=2**63 - 1), pairs.max(axis=1, initial=-(2**63))
        return [pa.array(low), pa.array(high)]

    for batch in batches:
        if not batch.num_rows:
            continue
        mask, key = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        points = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
        cuts = np.flatnonzero((np.diff(mask) != 0) | (np.diff(key) != 0)) + 1
        bounds = [0, *cuts.tolist(), len(points)]
        links: list[tuple[int, int]] = []
        first = (int(mask[0]), int(key[0]))
        if held and first != last:
            links += forest(np.concatenate(held), max_distance)
            held = []
        for a, b in zip(bounds, bounds[1:], strict=False):
            if b == len(points):
                held.append(points[a:b].copy())
            elif held:
                links += forest(np.concatenate([*held, points[a:b]]), max_distance)
                held = []
            elif b - a > 1:
                links += forest(points[a:b], max_distance)
        last = (int(mask[-1]), int(key[-1]))
        if links:
            yield out(links)
    if held and sum(map(len, held)) > 1 and (links := forest(np.concatenate(held), max_distance)):
        yield out(links)


def fingerprint_links(points: DataFrame, max_distance: int, blocks: int | None = None) -> DataFrame:
    """Links (a, b) that span the components of the distinct fingerprints in column ``fp``."""
    if max_distance == 0:
        return points.sparkSession.createDataFrame([], LINKS)
    blocks = blocks or blocks_for(points.count(), max_distance)
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in block_masks(blocks, max_distance)]
    keys = F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)])
    rows = points.select("fp", F.explode(keys).alias("k")).select("k.mask", "k.key", "fp")
    runs = rows.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
    return map_arrow(runs, lambda batches: run_links(batches, max_distance), LINKS).distinct()


def with_fingerprints(docs: DataFrame, text: str = "text", shingle: int = 4) -> DataFrame:
    """``docs`` without its text, plus ``fp``: the fingerprint as a signed 64-bit integer."""
    rest = without_columns(docs, "fp", text)
    ordered = docs.select(*[F.col(f"`{c}`") for c in rest.columns], F.col(f"`{text}`").cast("string"))

    def compute(batches):
        for batch in batches:
            points = [fingerprint(t.as_py(), shingle) for t in batch.columns[-1]]
            yield [*batch.columns[:-1], pa.array(np.array(points, np.uint64).view(np.int64))]

    return map_arrow(ordered, compute, StructType([*rest.schema.fields, StructField("fp", LongType())]))


def simhash_components(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    shingle: int = 4,
    max_distance: int = 4,
    blocks: int | None = None,
) -> DataFrame:
    """Per row of ``docs``: its id, ``fp`` and ``component_id``.

    Fingerprints link at ``max_distance`` or fewer differing bits; ``component_id`` is the smallest
    id reachable over links, the row's own included. A null or wordless text has fingerprint zero,
    linked like any other. Repeated rows and repeated ids each get a row. A null id takes part but is
    never the smallest; a component of null ids only has a null ``component_id``. An empty table gives
    an empty result.
    """
    prints = written(with_fingerprints(docs.select(F.col(id).alias("id"), F.col(f"`{text}`").alias("text")), "text", shingle), "simhash-prints")
    points = written(prints.groupBy("fp").agg(F.min("id").alias("first")), "simhash-points")
    links = fingerprint_links(points.select("fp"), max_distance, blocks)
    labels = connected_components(links).withColumnRenamed("node", "fp")
    named = points.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    smallest = named.groupBy("label").agg(F.min("first").alias("component_id"))
    classes = named.join(smallest, "label").select("fp", "component_id")
    return prints.join(classes, "fp").select(F.col("id").alias(id), "fp", "component_id")


def simhash_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 4, max_distance: int = 4) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, all columns kept.

    Rows that repeat an id are one document and share its fate. Rows without an id all stay, because
    nothing ranks them.
    """
    found = simhash_components(docs, id, text, shingle, max_distance)
    gone = found.where(F.col(id) != F.col("component_id")).select(F.col(id).alias("__gone")).distinct()
    return docs.join(gone, F.col(f"`{id}`") == F.col("__gone"), "left_anti")


def simhash_report(docs: DataFrame, **options) -> DataFrame:
    """``simhash_components`` with the fingerprint as 16 lower-case hex digits."""
    found = simhash_components(docs, **options)
    return with_columns(found, fingerprint=F.lpad(F.lower(F.hex("fp")), 16, "0")).drop("fp")
