"""Packing by Karmarkar-Karp multiway differencing.

Documents become token ids in the tasks that read them. Whole windows of a long document are
sequences as they are; what remains is cut into items of at most ``item`` tokens, and every
``batch`` items are split over as few windows as hold them: partial partitions with the largest
spread are merged against each other until one is left, and the number of windows rises while the
fullest exceeds the capacity. Nothing is shuffled; a task keeps one batch of items in memory.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .shared import map_arrow
from .tokens import FastEncoder

CAPACITY = 1024
ITEM = 256
BATCH = 1024
END = 0
PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Split item indexes over ``windows`` near-equal lists by the largest differencing method.

    A partial partition is a vector of window sums in falling order, with the tree of items of each
    window beside it. The two with the largest spread are merged, fullest with emptiest.
    """
    left, right = [-1] * len(sizes), [-1] * len(sizes)
    heap = []
    for i, size in enumerate(sizes):
        sums, trees = np.zeros(windows, np.int64), np.full(windows, -1, np.int64)
        sums[0], trees[0] = size, i
        heap.append((-size, i, sums, trees))
    heapq.heapify(heap)
    serial = len(heap)
    while len(heap) > 1:
        (_, _, sums, trees), (_, _, other, branch) = heapq.heappop(heap), heapq.heappop(heap)
        sums, branch = sums + other[::-1], branch[::-1]
        both = np.flatnonzero((trees >= 0) & (branch >= 0))
        joined = np.where(trees >= 0, trees, branch)
        joined[both] = np.arange(len(left), len(left) + len(both))
        left.extend(trees[both].tolist())
        right.extend(branch[both].tolist())
        order = np.argsort(-sums, kind="stable")
        sums, joined = sums[order], joined[order]
        serial += 1
        heapq.heappush(heap, (int(sums[-1] - sums[0]), serial, sums, joined))
    out = []
    for root in heap[0][3].tolist() if heap else []:
        items, stack = [], [root] if root >= 0 else []
        while stack:
            node = stack.pop()
            if left[node] < 0:
                items.append(node)
            else:
                stack += (right[node], left[node])
        out.append(sorted(items))
    return out


def windows_of(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Near-equal windows of items, none over ``capacity``; as few as differencing manages."""
    if not sizes:
        return []
    count = -(-sum(sizes) // capacity)
    while True:
        found = difference(sizes, count)
        if max(sum(sizes[i] for i in items) for items in found) <= capacity:
            return [items for items in found if items]
        count += 1


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def pack_partition(
    rows: Iterator[tuple[int | None, np.ndarray]], base: int, capacity: int, item: int, batch: int
) -> Iterator[list[tuple]]:
    """Lists of pieces for the (id, ids) ``rows`` of one task; sequences are numbered from ``base``."""
    waiting: list[tuple] = []
    serial = base

    def settle(pieces):
        nonlocal serial
        out = []
        for items in windows_of([p[2] for p in pieces], capacity):
            offset = 0
            for i in items:
                out.append((*pieces[i], serial, offset))
                offset += pieces[i][2]
            serial += 1
        return out

    for key, ids in rows:
        total, at, done = len(ids), 0, []
        while total - at >= capacity:
            done.append((key, at, capacity, crc(ids[at : at + capacity]), total, serial, 0))
            serial += 1
            at += capacity
        if done:
            yield done
        while at < total:
            size = min(item, total - at)
            waiting.append((key, at, size, crc(ids[at : at + size]), total))
            at += size
        while len(waiting) >= batch:
            yield settle(waiting[:batch])
            waiting = waiting[batch:]
    if waiting:
        yield settle(waiting)


def pack(
    docs: DataFrame,
    tokenizer: str,
    id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    item: int = ITEM,
    batch: int = BATCH,
) -> DataFrame:
    """Pieces of all ``docs``: which ids of which document stand where in which sequence.

    ``tokenizer`` is the path of a byte-level BPE file. A document is its ids and one end id (0); a
    null or empty text is the end id alone. Rows that repeat an id are packed one by one. A sequence
    id holds the task's partition number above bit 40, so a task that runs again gives the same
    pieces. An empty table gives no pieces. Other columns of ``docs`` are not carried.
    """
    rows = docs.select(F.col(f"`{id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches):
        encode = FastEncoder(tokenizer)

        def documents():
            for part in batches:
                for key, body in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    yield key, np.append(encode(body.as_py() or ""), np.int32(END))

        for pieces in pack_partition(documents(), TaskContext.get().partitionId() << 40, capacity, item, batch):
            yield [pa.array(c, pa.int64()) for c in zip(*pieces, strict=True)]

    return map_arrow(rows, run, StructType([StructField(n, LongType()) for n in PIECE]))
