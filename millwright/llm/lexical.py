"""Ranked lexical search: best-first document intervals over range-maximum tables.

The index cuts the documents into shards of bounded size. A shard holds, for every term, the
ordinals of its documents in id order and the counts there. To answer an item, a shard lays a sparse
table over the impacts of the postings of the item's terms: the largest impact between two positions
is then two look-ups. Search keeps document intervals in a priority queue by the sum of their terms'
range maxima, which no document inside can exceed. The best interval is split at the document with its
largest impact, that document is scored exactly, and both halves go back with bounds of their own.
The queue ends when no bound reaches the k-th score.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import map_arrow, running_totals, ship, written

SHARD_BYTES = 8 << 20  # of text; a longer text is a shard of its own
BLOCK_BYTES = 1 << 20  # of item text, the unit in which items go to every task
BATCH = 32  # intervals taken from the queue at a time
NULL_ID = np.iinfo(np.int64).max  # stands for a null id inside a shard: after all others

INDEX = "shard bigint, term binary, docs array<bigint>, counts array<bigint>"
FOUND = "item bigint, doc_id bigint, missing boolean, score bigint"

# Terms are runs of ASCII letters and digits and of everything beyond ASCII; only A-Z change case.
LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def terms(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text in order."""
    return text.translate(LETTERS).split()


def shard_rows(shard: int, ids: list[int], bodies: list[bytes]) -> list[pa.Array]:
    """Index rows of one shard: its documents (term null: ids and lengths), then one row per term."""
    order = np.argsort(np.array(ids, np.int64), kind="stable")
    vocabulary: defaultdict[bytes, int] = defaultdict()
    vocabulary.default_factory = vocabulary.__len__
    lengths, held, counts, sizes = [], [], [], []
    for at in order:
        words = terms(bodies[at])
        tally = Counter(words)
        lengths.append(len(words))
        sizes.append(len(tally))
        held.extend(map(vocabulary.__getitem__, tally))
        counts.extend(tally.values())
    held = np.array(held, np.int64)
    ordinals = np.repeat(np.arange(len(ids), dtype=np.int64), np.array(sizes, np.int64))
    by_term = np.argsort(held, kind="stable")
    ends = np.cumsum(np.r_[len(ids), np.bincount(held, minlength=len(vocabulary))])
    offsets = pa.array(np.r_[0, ends], pa.int32())
    docs = np.r_[np.array(ids, np.int64)[order], ordinals[by_term]]
    tallies = np.r_[np.array(lengths, np.int64), np.array(counts, np.int64)[by_term]]
    return [
        pa.array(np.full(len(vocabulary) + 1, shard), pa.int64()),
        pa.array([None, *vocabulary], pa.binary()),
        pa.ListArray.from_arrays(offsets, pa.array(docs, pa.int64())),
        pa.ListArray.from_arrays(offsets, pa.array(tallies, pa.int64())),
    ]


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """A written index of all ``docs`` (doc_id, text): see :func:`shard_rows`."""

    def run(batches):
        task, number, ids, bodies, held = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in batches:
            numbers, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
            for id, text in zip(numbers, texts, strict=True):
                body = text.as_py() or b""
                if ids and held + len(body) > shard_bytes:
                    yield shard_rows(task << 32 | number, ids, bodies)
                    number, ids, bodies, held = number + 1, [], [], 0
                ids.append(NULL_ID if id is None else id)
                bodies.append(body)
                held += len(body) + 64
        if ids:
            yield shard_rows(task << 32 | number, ids, bodies)

    plain = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return written(map_arrow(plain, run, StructType.fromDDL(INDEX)), "lexical-index")


class Shard:
    """The postings of some terms in one shard, with a sparse table of range maxima over them.

    ``postings`` lists (ordinals, counts) of each term in ``weights``, and ``lengths`` the terms of each
    document. One table covers all postings laid end to end; ranges never leave a term's own.
    """

    def __init__(self, lengths: np.ndarray, postings: list, weights: np.ndarray, documents: int, all_terms: int):
        self.size = len(lengths)
        sizes = np.array([len(o) for o, _ in postings], np.int64)
        self.starts = np.r_[0, np.cumsum(sizes)]
        self.ordinal = np.concatenate([o for o, _ in postings])
        tf = np.concatenate([c for _, c in postings])
        m = 25 + (75 * lengths * documents) // max(all_terms, 1)
        row = np.repeat(np.arange(len(postings), dtype=np.int64), sizes)
        self.impact = np.repeat(weights, sizes) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[self.ordinal]))
        self.key = row * self.size + self.ordinal
        levels = [np.arange(len(self.key), dtype=np.int32)]
        for j in range(int(sizes.max()).bit_length() - 1):
            low, high = levels[-1], levels[-1].copy()
            high[: -(1 << j)] = low[1 << j :]
            levels.append(np.where(self.impact[low] >= self.impact[high], low, high))
        self.table = np.stack(levels)

    def maxima(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Position of the largest impact in each range; any position where the range is empty."""
        width = np.maximum(right - left, 1)
        j = np.frexp(width)[1] - 1
        a = self.table[j, np.minimum(left, len(self.key) - 1)]
        b = self.table[j, np.maximum(right - (1 << j), 0)]
        return np.where(self.impact[a] >= self.impact[b], a, b)

    def search(self, rows: np.ndarray, times: np.ndarray, k: int) -> tuple[list[int], list[int]]:
        """(ordinals, scores) of the ``k`` best documents above 0, for terms ``rows`` that an item holds
        ``times`` over; equal scores by ordinal."""
        least = 1
        best: list[tuple[int, int]] = []  # (score, -ordinal), smallest first
        queue: list = []
        serial = 0

        def push(left, right):
            nonlocal serial
            spot = self.maxima(left, right)
            top = np.where(right > left, times * self.impact[spot], 0)
            bound = top.sum(axis=1)
            split = self.ordinal[np.take_along_axis(spot, top.argmax(axis=1)[:, None], 1)[:, 0]]
            for i in np.flatnonzero(bound >= least):
                serial += 1
                heapq.heappush(queue, (-int(bound[i]), serial, int(split[i]), left[i], right[i]))

        push(self.starts[rows][None, :], self.starts[rows + 1][None, :])
        step = 1
        while queue and -queue[0][0] >= least:
            taken = [heapq.heappop(queue) for _ in range(min(step, len(queue)))]
            step = min(2 * step, BATCH)
            split = np.array([t[2] for t in taken], np.int64)
            left, right = np.stack([t[3] for t in taken]), np.stack([t[4] for t in taken])
            wanted = rows * self.size + split[:, None]
            at = np.searchsorted(self.key, wanted)
            here = (at < right) & (self.key[np.minimum(at, len(self.key) - 1)] == wanted)
            scores = np.where(here, times * self.impact[np.minimum(at, len(self.key) - 1)], 0).sum(axis=1)
            for score, doc in zip(scores.tolist(), split.tolist(), strict=True):
                if score >= least:
                    heapq.heappush(best, (score, -doc))
            while len(best) > k:
                heapq.heappop(best)
            if len(best) == k:
                least = max(least, best[0][0])
            push(np.concatenate([left, at + here]), np.concatenate([at, right]))
        best.sort(reverse=True)
        return [-d for _, d in best], [s for s, _ in best]


def weight(documents: int, holding: int) -> int:
    """Weight of a term that ``holding`` of ``documents`` documents have."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def item_blocks(items: DataFrame, block_bytes: int) -> DataFrame:
    """Items numbered (``item``) and dealt out in ``block``s of about ``block_bytes`` of text."""
    size = F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("bigint") + 64
    numbered = items.select(
        F.monotonically_increasing_id().alias("item"),
        F.col("item_id").cast("bigint").alias("item_id"),
        F.col("text").cast("string").alias("text"),
        size.alias("size"),
        F.lit(0).cast("bigint").alias("all"),
    )
    ranked = running_totals(written(numbered, "lexical-items"), ["all", "item"], "size", "all", "lexical-blocks")
    return ranked.withColumn("block", F.floor(F.col("before") / block_bytes).cast("bigint"))


def best_of_shards(postings: DataFrame, documents: DataFrame, items: list, weights: dict[int, int], totals, k: int) -> DataFrame:
    """The ``k`` best documents that each shard has for each of ``items`` (item, term numbers, times)."""
    count, all_terms = totals
    ship(postings.sparkSession)

    def find(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"item": [], "doc_id": [], "missing": [], "score": []}
        if len(left):
            left = left.sort_values("number")
            numbers = left["number"].to_numpy()
            ids, lengths = right["docs"].iloc[0], right["counts"].iloc[0]
            own = np.array([weights[n] for n in numbers.tolist()], np.int64)
            shard = Shard(lengths, list(zip(left["docs"], left["counts"], strict=True)), own, count, all_terms)
            for item, wanted, times in items:
                at = np.searchsorted(numbers, wanted)
                here = numbers[np.minimum(at, len(numbers) - 1)] == wanted
                if here.any():
                    ordinals, scores = shard.search(at[here], times[here], k)
                    found = ids[np.array(ordinals, np.int64)]
                    out["item"] += [item] * len(scores)
                    out["doc_id"] += found.tolist()
                    out["missing"] += (found == NULL_ID).tolist()
                    out["score"] += scores
        return pd.DataFrame(out)

    held = postings.select("shard", "number", "docs", "counts").groupBy("shard")
    return held.cogroup(documents.select("shard", "docs", "counts").groupBy("shard")).applyInPandas(find, FOUND)


def search(items: DataFrame, docs: DataFrame, k: int = 10, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best ``docs`` (doc_id, text) for each of ``items`` (item_id, text).

    A null or empty text has no terms: such an item has no rows, such a document is in no result and does
    not count. Texts are used whole, however long. Equal scores go by ascending doc_id, a null doc_id
    after all others. Every row is a document or an item of its own, also if ids repeat, so an item_id
    that occurs twice has its rows twice. Other columns are ignored. Empty tables give an empty result.

    The index is written once; then one pass over it answers a block of items. The terms of a block are
    the only thing sent to every task, and ``block_bytes``, or one longer item, bounds them.
    """
    spark = docs.sparkSession
    index = build_index(docs, shard_bytes)
    documents, held = index.where(F.col("term").isNull()), index.where(F.col("term").isNotNull())
    totals = documents.agg(
        F.coalesce(F.sum(F.size(F.filter("counts", lambda n: n > 0)).cast("bigint")), F.lit(0)),
        F.coalesce(F.sum(F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, n: a + n)), F.lit(0)),
    ).first()
    blocks = written(item_blocks(items, block_bytes), "lexical-queries")
    found = []
    for block in sorted(r[0] for r in blocks.select("block").distinct().collect()):
        tallies = [
            (r["item"], Counter(terms((r["text"] or "").encode())))
            for r in blocks.where(F.col("block") == block).select("item", "text").collect()
        ]
        number: dict[bytes, int] = {}
        for _, tally in tallies:
            for term in tally:
                number.setdefault(term, len(number))
        names = spark.createDataFrame(
            [(bytearray(t), n) for t, n in number.items()], "term binary, number bigint"
        )
        postings = written(held.join(F.broadcast(names), "term").drop("term"), "lexical-postings")
        holding = postings.groupBy("number").agg(F.sum(F.size("docs").cast("bigint")).alias("df")).collect()
        weights = {r["number"]: weight(totals[0], r["df"]) for r in holding}
        asked = []
        for item, tally in tallies:
            wanted = sorted((number[t], n) for t, n in tally.items())
            asked.append((item, np.array([n for n, _ in wanted], np.int64), np.array([c for _, c in wanted], np.int64)))
        found.append(written(best_of_shards(postings, documents, asked, weights, totals, k), "lexical-found"))
    if not found:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    best = Window.partitionBy("item").orderBy(F.desc("score"), "missing", "doc_id")
    ranked = reduce(DataFrame.unionAll, found).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    doc_id = F.when(~F.col("missing"), F.col("doc_id")).alias("doc_id")
    return ranked.join(blocks.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), doc_id, "score")
