"""Language-model scoring with a log-frequency Bloom filter of quantised bigram counts.

Counts are combined in the tasks and then per segment of the hash space, of which there are as many
as the training text needs. A bigram of count ``c`` is put into its segment's filter once for each
level up to ``1 + floor(log2 c)``; a count is read back by probing level after level until one is
missing, so it never comes out below the true level. Unigram counts are exact, in sorted arrays beside
the filters. Keys travel in chunks, one for each segment, never one by one. A model of a bounded size is
broadcast, in parts that the driver holds one at a time. A larger one is asked where it is built: texts
are gathered in blocks, each block sends its different keys with their training counts to the segments,
where the same filters are filled, then probed for all blocks, and reads the answers back. Either way
the number of passes over the texts does not depend on the size of the model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, LongType, StructField, StructType

from .shared import map_arrow, written

LEAST_SEGMENT_BITS = 12
MOST_SEGMENT_BITS = 30
SEGMENT_TEXT = 4 << 20  # bytes of training text for each segment
BITS_PER_ENTRY = 8
PROBES = 5
MU = 2000.0
BROADCAST_BYTES = 128 << 20
PART_BYTES = 32 << 20
SLICE_BYTES = 1 << 20
BLOCK_BYTES = 8 << 20  # of text that asks for its keys together
HELD_ROWS = 1 << 21
SENT_KEYS = 1 << 19  # keys that leave a task in one batch
END_WORD = b" "  # no word holds a space

SEGMENT = StructType(
    [
        StructField("segment", LongType()),
        StructField("words", BinaryType()),
        StructField("counts", BinaryType()),
        StructField("filter", BinaryType()),
        StructField("bits", LongType()),
        StructField("n_words", LongType()),
        StructField("n_tokens", LongType()),
    ]
)

#: Different keys of a block (or of any rows, in a fit) in one segment, in order, with their training counts:
#: a byte each, and those of ``LARGE`` and more once again in full.
CHUNK = StructType(
    [
        StructField("segment", LongType()),
        StructField("block", LongType()),
        *[StructField(n, BinaryType()) for n in ("words", "word_counts", "large_word_counts", "pairs", "pair_counts", "large_pair_counts")],
    ]
)
LARGE = 255
#: Training counts of a block's words and levels of its bigrams in one segment, in the order of the keys.
#: What the segment holds stands in its first row, 0 in the others.
ANSWER = StructType(
    [
        StructField("segment", LongType()),
        StructField("block", LongType()),
        StructField("counts", BinaryType()),
        StructField("levels", BinaryType()),
        StructField("n_words", LongType()),
        StructField("n_tokens", LongType()),
    ]
)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's words and then its end, and where each text starts."""
    words: list[bytes] = []
    starts = []
    for text in texts:
        starts.append(len(words))
        if text:
            words += text.encode("utf-8", "surrogatepass").lower().split()
        words.append(END_WORD)
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False), np.array(starts, np.int64)


END_HASH = pd.util.hash_array(np.array([END_WORD], dtype=object), categorize=False)[0]


def contexts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The token before each token; the end token before a text."""
    before = np.empty_like(hashes)
    before[1:] = hashes[:-1]
    before[starts] = END_HASH
    return before


def bigrams(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return mix(mix(contexts(hashes, starts)) + np.uint64(0x9E3779B97F4A7C15) * hashes)


def slices(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts of a few MB, with the place of the first."""
    part, size, at = [], 0, 0
    for i, value in enumerate(column):
        part.append(value.as_py())
        size += len(part[-1] or "") + 16
        if size >= SLICE_BYTES:
            yield at, part
            part, size, at = [], 0, i + 1
    if part:
        yield at, part


def in_order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places that sort ``keys``, equal ones as they stand, and the keys in that order.

    The leading bits in which keys differ are sorted with the place in the others, about twice as fast as places
    are; if different keys share those bits and come out of order, the places are sorted after all.
    """
    if not len(keys):
        return np.zeros(0, np.int64), keys
    free = np.uint64(max(1, len(keys) - 1).bit_length())
    same = np.uint64(min(63, 64 - int(keys.max() ^ keys.min()).bit_length()))
    order = (keys << same >> free << free) | np.arange(len(keys), dtype=np.uint64)
    order.sort()
    order = (order & ((np.uint64(1) << free) - np.uint64(1))).astype(np.int64)
    found = keys[order]
    if (found[1:] < found[:-1]).any():
        order = np.argsort(keys, kind="stable")
        found = keys[order]
    return order, found


def firsts(found: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    return np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, np.int64)


def combined(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, with their summed counts."""
    order, found = in_order(keys)
    first = firsts(found)
    return found[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and for each of ``keys`` its place among them."""
    order, found = in_order(keys)
    first = firsts(found)
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
    return found[first], rank


def binaries(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """One binary for each two neighbours among ``cuts``, which are places in ``values``."""
    offsets = ((cuts - cuts[0]) * values.itemsize).astype(np.int32)
    data = np.ascontiguousarray(values[cuts[0] : cuts[-1]])
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def joined(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The values of all binaries of a column, and how many each has."""
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    size = np.dtype(kind).itemsize
    if not len(column) or offsets[0] == offsets[-1]:
        return np.zeros(0, kind), np.zeros(len(column), np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return np.frombuffer(data.tobytes(), kind), np.diff(offsets) // size


def counted(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and counts of the chunks of a batch, from three columns behind ``at``, and how many keys each chunk has."""
    keys, sizes = joined(batch.column(at), np.uint64)
    counts = joined(batch.column(at + 1), np.uint8)[0].astype(np.int64)
    counts[counts == LARGE] = joined(batch.column(at + 2), np.int64)[0]
    return keys, counts, sizes


def chunked(block: int, words: np.ndarray, word_counts: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray, bits: int) -> Iterator[list[pa.Array]]:
    """Rows of ``CHUNK``: sorted keys and their counts, cut at the borders of segments of ``bits`` bits."""
    shift = np.uint64(64 - bits)
    own = [words >> shift, pairs >> shift]
    segments = np.union1d(*(x[firsts(x)] for x in own))
    cuts = [np.append(np.searchsorted(x, segments), len(x)) for x in own]
    large = [np.flatnonzero(n >= LARGE) for n in (word_counts, pair_counts)]
    at = 0
    while at < len(segments):
        end = max(at + 1, int(np.searchsorted(cuts[0] + cuts[1], cuts[0][at] + cuts[1][at] + SENT_KEYS, "right")) - 1)
        row = [pa.array(segments[at:end].astype(np.int64)), pa.array(np.full(end - at, block, np.int64))]
        for keys, counts, cut, full in zip((words, pairs), (word_counts, pair_counts), cuts, large, strict=True):
            cut = cut[at : end + 1]
            row += [binaries(keys, cut), binaries(np.minimum(counts, LARGE).astype(np.uint8), cut), binaries(counts[full], np.searchsorted(full, cut))]
        yield row
        at = end


def partial_counts(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[list[pa.Array]]:
    """Chunks of the unigrams and bigrams of a task, combined before they leave it."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {1: [], 2: []}
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def flush(order):
        parts, held[order] = held[order], []
        found = combined(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        return chunked(0, *(found if order == 1 else none), *(found if order == 2 else none), bits)

    for batch in batches:
        for _, texts in slices(batch.column(0)):
            hashes, starts = tokens(texts)
            for order, keys in ((1, hashes), (2, bigrams(hashes, starts))):
                keys = np.sort(keys)
                first = firsts(keys)
                held[order].append((keys[first], np.diff(np.append(first, len(keys)))))
                if sum(len(p[0]) for p in held[order]) >= HELD_ROWS:
                    yield from flush(order)
    for order, parts in held.items():
        if parts:
            yield from flush(order)


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (segment, order, hash, count) of chunks sorted by segment, a batch for each run of one segment."""
    for batch in batches:
        segment = batch.column(0).to_numpy()
        starts = firsts(segment)
        (words, times, n_words), (pairs, pair_times, n_pairs) = counted(batch, 2), counted(batch, 5)
        at, pair_at = (np.append(0, np.cumsum(n)) for n in (n_words, n_pairs))
        for a, b in zip(starts, [*starts[1:], len(segment)], strict=True):
            one, two = slice(at[a], at[b]), slice(pair_at[a], pair_at[b])
            order = np.repeat([1, 2], [one.stop - one.start, two.stop - two.start])
            keys, counts = np.append(words[one], pairs[two]), np.append(times[one], pair_times[two])
            rows = np.full(len(order), segment[a]), order, keys.view(np.int64), counts
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["segment", "order", "hash", "n"])


def walk(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the probes of keys start at a level, and how far apart they are, both before the number of bits divides them."""
    first = mix(keys + np.uint64(level * 0x9E3779B97F4A7C15 & (2**64 - 1)))
    return first, mix(first) | np.uint64(1)


def levels(counts: np.ndarray) -> np.ndarray:
    """Quantised counts: 1 + floor(log2 count)."""
    return np.frexp(counts.astype(np.float64))[1]


def segment_filter(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, int]:
    """The Bloom filter of one segment, sized by what it holds."""
    level = levels(counts)
    bits = max(64, -(-BITS_PER_ENTRY * int(level.sum()) // 8) * 8)
    field = np.zeros(bits, bool)
    for at in range(1, int(level.max(initial=0)) + 1):
        place, step = walk(keys[level >= at], at)
        for _ in range(PROBES):
            field[place % np.uint64(bits)] = True
            place += step
    return np.packbits(field, bitorder="little").tobytes(), bits


def build_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
    """One row per segment from rows (segment, order, hash, count) sorted by segment.

    Counts of a segment are combined whenever many are held, so a frequent word that every task counted
    takes no more room than its own.
    """
    held: list[list[np.ndarray]] = []
    current, size, limit = None, 0, HELD_ROWS

    def by_order():
        order, keys, counts = (np.concatenate([h[i] for h in held]) for i in range(3))
        keys = keys.view(np.uint64)
        for at in (1, 2):
            own = order == at
            yield combined(keys[own], counts[own]) if own.any() else (keys[:0], counts[:0])

    def out():
        (words, times), (pairs, pair_times) = by_order()
        data, bits = segment_filter(pairs, pair_times)
        row = (current, words.tobytes(), times.tobytes(), data, bits, len(words), int(times.sum()))
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        return [pa.array([v], t) for v, t in zip(row, kinds, strict=True)]

    for batch in batches:
        if not batch.num_rows:
            continue
        segment, *rest = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        cuts = [0, *(np.flatnonzero(np.diff(segment)) + 1).tolist(), len(segment)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and segment[a] != current:
                yield out()
                held, size, limit = [], 0, HELD_ROWS
            current = int(segment[a])
            held.append([x[a:b].copy() for x in rest])
            size += b - a
            if size > limit:
                held = [[np.full(len(k), at, np.int64), k.view(np.int64), n] for at, (k, n) in enumerate(by_order(), 1)]
                size = sum(len(h[0]) for h in held)
                limit = max(HELD_ROWS, 2 * size)
    if held:
        yield out()


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")) + 1)).first()[0] or 0


def bits_for(size: int) -> int:
    """How many leading bits of a hash name its segment: a segment for every few MB of text."""
    return min(MOST_SEGMENT_BITS, max(LEAST_SEGMENT_BITS, (size // SEGMENT_TEXT).bit_length()))


def segment_bits(docs: DataFrame, text: str = "text") -> int:
    """The bits of the segments of a model learned from ``docs``."""
    return bits_for(text_bytes(docs, text))


def fit_model(docs: DataFrame, bits: int, text: str = "text") -> DataFrame:
    """The model learned from all rows of ``docs``: one written row per segment, of ``bits`` bits, of the hash space."""
    counts = map_arrow(docs.select(F.col(f"`{text}`")), lambda batches: partial_counts(batches, bits), CHUNK)
    spread = counts.repartition("segment").sortWithinPartitions("segment")
    return written(map_arrow(spread, lambda batches: build_segments(unpacked(batches)), SEGMENT), "lm-model", clean=True)


class Shard:
    """Segments between two, ready for lookup; segments are runs of the hash space, so words stay sorted."""

    def __init__(self, rows: list, low: int, high: int, segment_bits: int):
        words, counts, field = bytearray(), bytearray(), bytearray()
        self.low, self.high, self.shift = low, high, np.uint64(64 - segment_bits)
        self.start = np.zeros(high - low + 1, np.int64)
        self.bits = np.zeros(high - low + 1, np.int64)
        for r in sorted(rows, key=lambda r: r["segment"]):
            self.start[r["segment"] - low], self.bits[r["segment"] - low] = len(field), r["bits"]
            words += r["words"]
            counts += r["counts"]
            field += r["filter"]
        self.words, self.counts = np.frombuffer(words, np.uint64), np.frombuffer(counts, np.int64)
        self.field = np.frombuffer(field, np.uint8)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys whose segments are here."""
        segment = keys >> self.shift
        return np.flatnonzero((segment >= self.low) & (segment <= self.high))

    def word_counts(self, hashes: np.ndarray) -> np.ndarray:
        """Exact training counts; 0 for words that are not in the shard."""
        if not len(self.words):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.counts[at], 0)

    def pair_levels(self, keys: np.ndarray) -> np.ndarray:
        """Levels of bigrams: probes level after level until one is missing."""
        out = np.zeros(len(keys), np.uint8)
        segment = (keys >> self.shift).astype(np.int64) - self.low
        bits, start = self.bits[segment].astype(np.uint64), self.start[segment]
        alive = np.flatnonzero(bits)
        level = 0
        while alive.size:
            level += 1
            place, step = walk(keys[alive], level)
            for _ in range(PROBES):
                at = (place % bits[alive]).astype(np.int64)
                hit = np.flatnonzero(self.field[start[alive] + (at >> 3)] >> (at & 7).astype(np.uint8) & 1)
                alive, step = alive[hit], step[hit]
                place = place[hit] + step
            out[alive] = level
        return out


def looked_up(parts: list[Shard], hashes: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word counts and bigram levels from the parts that hold their segments, 0 where none does."""
    count, level = np.zeros(len(hashes), np.int64), np.zeros(len(pairs), np.uint8)
    for shard in parts:
        at = shard.holds(hashes)
        count[at] = shard.word_counts(hashes[at])
        at = shard.holds(pairs)
        level[at] = shard.pair_levels(pairs[at])
    return count, level


def model_bytes() -> Column:
    return F.length("words") + F.length("counts") + F.length("filter")


def shards(model: DataFrame, most: int) -> list[tuple[int, int]]:
    """Segment ranges of a model to be broadcast whose arrays fit into ``most`` bytes each; a segment is never split."""
    out, total = [], 0
    for segment, own in sorted(tuple(r) for r in model.select("segment", model_bytes()).collect()):
        if not out or total + own > most:
            out.append((segment, segment))
            total = 0
        total += own
        out[-1] = (out[-1][0], segment)
    return out


def in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
    """Rows (..., text) behind the number of their block: neighbours of a task, up to ``BLOCK_BYTES`` or one text."""
    serial, size = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        blocks = np.empty(batch.num_rows, np.int64)
        for i, own in enumerate(pc.fill_null(pc.binary_length(batch.columns[-1]), 0).to_pylist()):
            if size and size + own > BLOCK_BYTES:
                serial, size = serial + 1, 0
            size += own + 16
            blocks[i] = serial
        yield [pa.array(blocks), *batch.columns]


def asked_keys(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[list[pa.Array]]:
    """Chunks of the different words and bigrams of the blocks in rows (block, held_out, text).

    Keys of held-out texts alone have a count of 0: they are asked for, not learned.
    """
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    current = None

    def flush():
        hashes, pairs, learned = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        yield from chunked(current, *combined(hashes, learned), *combined(pairs, learned), bits)

    for batch in batches:
        blocks, training = batch.column(0).to_numpy(), ~batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for at, texts in slices(batch.column(2)):
            hashes, starts = tokens(texts)
            pairs, ends = bigrams(hashes, starts), np.append(starts, len(hashes))
            learned = np.repeat(training[at : at + len(texts)].astype(np.int64), np.diff(ends))
            own = blocks[at : at + len(texts)]
            rows = firsts(own)
            for row, end in zip(rows, [*rows[1:], len(own)], strict=True):
                if held and own[row] != current:
                    yield from flush()
                current = int(own[row])
                part = slice(ends[row], ends[end])
                held.append((hashes[part], pairs[part], learned[part]))
    if held:
        yield from flush()


def by_block(keys: np.ndarray, sizes: np.ndarray, blocks: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``keys``, in chunks of these sizes, answer each block, and how many do.

    A block that two tasks read asked in two chunks; its answer is that of their different keys, in order.
    """
    places = np.arange(len(keys))
    if len(starts) == len(blocks):
        return places, sizes
    cuts = np.append(0, np.cumsum(sizes))
    parts = []
    for a, b in zip(starts, [*starts[1:], len(blocks)], strict=True):
        own = places[cuts[a] : cuts[b]]
        parts.append(own if b == a + 1 else own[np.unique(keys[own], return_index=True)[1]])
    return np.concatenate(parts), np.array([len(p) for p in parts])


def answered(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[list[pa.Array]]:
    """Rows of ``ANSWER`` from chunks sorted by segment and block.

    All chunks of a segment are held: what blocks ask of one segment is bounded as its text is. The segment is
    built of them, filter included, and probed once for each different key.
    """
    held: list[pa.RecordBatch] = []

    def flush():
        (words, times, n_words), (pairs, pair_times, n_pairs) = (
            map(np.concatenate, zip(*(counted(part, at) for part in held), strict=True)) for at in (2, 5)
        )
        blocks = np.concatenate([part.column(1).to_numpy() for part in held])
        segment = held[0].column(0)[0].as_py()
        held.clear()
        starts = firsts(blocks)
        (word, rank), (pair, pair_rank) = ranked(words), ranked(pairs)
        # Sums of whole numbers, exact below 2^53.
        count = np.bincount(rank, times, len(word)).astype(np.int64)
        pair_count = np.bincount(pair_rank, pair_times, len(pair)).astype(np.int64)
        learned = pair_count > 0
        data, size = segment_filter(pair[learned], pair_count[learned])
        row = {"segment": segment, "words": b"", "counts": b"", "filter": data, "bits": size if learned.any() else 0}
        level = Shard([row], segment, segment, bits).pair_levels(pair)
        at, sizes = by_block(words, n_words, blocks, starts)
        pair_at, pair_sizes = by_block(pairs, n_pairs, blocks, starts)
        first = np.zeros(len(starts), np.int64)
        first[0] = 1
        yield [
            pa.array(np.full(len(starts), segment)),
            pa.array(blocks[starts]),
            binaries(count[rank[at]], np.append(0, np.cumsum(sizes))),
            binaries(level[pair_rank[pair_at]], np.append(0, np.cumsum(pair_sizes))),
            pa.array(first * np.count_nonzero(count)),
            pa.array(first * count.sum()),
        ]

    for batch in batches:
        segment = batch.column(0).to_numpy()
        starts = firsts(segment)
        for a, b in zip(starts, [*starts[1:], len(segment)], strict=True):
            if held and held[0].column(0)[0].as_py() != segment[a]:
                yield from flush()
            held.append(batch.slice(a, b - a))
    if held:
        yield from flush()


def text_scores(hashes, starts, count, level, total: int, vocabulary: int, mu: float) -> list[np.ndarray]:
    """Per text: tokens, known tokens, add-one unigram score, interpolated bigram score (log10)."""
    norm = total + vocabulary + 1
    single = (count + 1) / norm
    before = np.empty_like(count)
    before[1:] = count[:-1]
    ends = np.flatnonzero(hashes == END_HASH)
    before[starts] = count[ends[0]]
    pair = np.minimum(np.where(level > 0, np.exp2(level.astype(np.float64) - 1), 0.0), before)
    smooth = (pair + mu * single) / (before + mu)
    return [
        np.diff(np.append(starts, len(hashes))),
        np.add.reduceat((count > 0).astype(np.int64), starts),
        np.add.reduceat(np.log10(single), starts),
        np.add.reduceat(np.log10(smooth), starts),
    ]


def score(
    docs: DataFrame,
    held_out: Column,
    id: str = "doc_id",
    text: str = "text",
    mu: float = MU,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Score all ``docs``, learning from those that are not ``held_out``.

    Returns id, held_out, n_tokens, n_known, train_tokens, base_score, score. Tokens are the words
    (A-Z in lower case) and one end per text; a null text is its end alone. ``base_score`` is the
    add-one unigram log10 probability, exact. ``score`` interpolates the bigram count read from the
    filter with it: (c2 + mu p1) / (c1 + mu), c2 at the lower edge of its level, so probabilities
    after a word sum to at most one but for false hits (about two in a hundred probes of unseen pairs).
    Without training rows every probability is 1. A null ``held_out`` counts as held out. Rows,
    repeated ones included, are scored one by one; an empty table gives an empty result.
    """
    rows = docs.select(
        F.col(f"`{id}`").alias("id"), F.coalesce(held_out, F.lit(True)).alias("held_out"), F.col(f"`{text}`").cast("string").alias("text")
    )
    training = rows.where(~F.col("held_out"))
    text_size = text_bytes(training)
    bits = bits_for(text_size)
    # A text of so many bytes has hardly ever a larger model; where it has, the blocks ask for it all the same.
    small = text_size <= broadcast_bytes
    if small:
        model = fit_model(training, bits)
        vocabulary, total, size = (x or 0 for x in model.agg(F.sum("n_words"), F.sum("n_tokens"), F.sum(model_bytes())).first())
        small = size <= broadcast_bytes
    if not small:
        blocks, answers = asked_blocks(rows, bits)
        vocabulary, total = (x or 0 for x in answers.agg(F.sum("n_words"), F.sum("n_tokens")).first())

    def scored(own: list[pa.Array], hashes, starts, count, level) -> list[pa.Array]:
        found = text_scores(hashes, starts, count, level, total, vocabulary, mu)
        return [*own, *map(pa.array, [found[0], found[1], np.full(len(starts), total, np.int64), found[2], found[3]])]

    names = [("n_tokens", LongType()), ("n_known", LongType()), ("train_tokens", LongType()), ("base_score", DoubleType()), ("score", DoubleType())]
    head = [rows.schema["id"], StructField("held_out", BooleanType())]
    schema = StructType([*head, *[StructField(n, t) for n, t in names]])
    found = by_broadcast(rows, model, bits, scored, schema) if small else by_blocks(blocks, answers, scored, schema)
    return found.withColumnRenamed("id", id)


def by_broadcast(rows: DataFrame, model: DataFrame, bits: int, scored: Callable, schema: StructType) -> DataFrame:
    """Rows (id, held_out, text) scored by a model that goes to every task, in broadcasts of ``PART_BYTES``."""
    context = rows.sparkSession.sparkContext
    sent = [
        context.broadcast(Shard(model.where(F.col("segment").between(low, high)).collect(), low, high, bits))
        for low, high in shards(model, PART_BYTES)
    ]

    def run(batches):
        parts = [shard.value for shard in sent]
        for batch in batches:
            for at, texts in slices(batch.column(2)):
                hashes, starts = tokens(texts)
                (words, rank), (pairs, pair_rank) = ranked(hashes), ranked(bigrams(hashes, starts))
                count, level = looked_up(parts, words, pairs)
                yield scored(batch.slice(at, len(texts)).columns[:2], hashes, starts, count[rank], level[pair_rank])

    return map_arrow(rows, run, schema)


def asked_blocks(rows: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, held_out, text) in written blocks, and the answers of the model of those not held out to each block."""
    blocks = written(map_arrow(rows, in_blocks, StructType([StructField("block", LongType()), *rows.schema.fields])), "lm-blocks")
    chunks = map_arrow(blocks.select("block", "held_out", "text"), lambda batches: asked_keys(batches, bits), CHUNK)
    spread = chunks.repartition("segment").sortWithinPartitions("segment", "block")
    return blocks, written(map_arrow(spread, lambda batches: answered(batches, bits), ANSWER), "lm-answers", clean=True)


def by_blocks(blocks: DataFrame, answers: DataFrame, scored: Callable, schema: StructType) -> DataFrame:
    """Blocks of rows (id, held_out, text) scored by the answers to their keys, by a model of any size."""
    empty = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in (*blocks.schema.fields, *answers.schema.fields)}
    own, told = ["id", "held_out", "text"], ["segment", "counts", "levels"]
    told_rows = answers.select("block", F.lit(0).alias("kind"), *told, *[empty[n] for n in own])
    texts = blocks.select("block", F.lit(1).alias("kind"), *[empty[n] for n in told], *own)
    met = told_rows.unionByName(texts).repartition("block").sortWithinPartitions("block", "kind", "segment")

    def run(batches):
        current, counts, levels, parts = None, [], [], []

        def flush():
            words, rank = ranked(np.concatenate([p[1] for p in parts]))
            pairs, pair_rank = ranked(np.concatenate([bigrams(*p[1:]) for p in parts]))
            count, level = np.concatenate(counts), np.concatenate(levels)
            if (len(count), len(level)) != (len(words), len(pairs)):
                raise ValueError(f"block {current}: {len(count)} words and {len(level)} bigrams answered of {len(words)} and {len(pairs)}")
            at = 0
            for columns, hashes, begins in parts:
                place = slice(at, at + len(hashes))
                yield scored(columns, hashes, begins, count[rank[place]], level[pair_rank[place]])
                at = place.stop

        for batch in batches:
            block, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            starts = np.flatnonzero(np.r_[True, (np.diff(block) != 0) | (np.diff(kind) != 0)])
            for a, b in zip(starts, [*starts[1:], len(block)], strict=True):
                if block[a] != current:
                    if parts:
                        yield from flush()
                    current, counts, levels, parts = int(block[a]), [], [], []
                part = batch.slice(a, b - a)
                if kind[a] == 0:
                    counts.append(joined(part.column(3), np.int64)[0])
                    levels.append(joined(part.column(4), np.uint8)[0])
                    continue
                for at, bodies in slices(part.column(7)):
                    parts.append((part.slice(at, len(bodies)).columns[5:7], *tokens(bodies)))
        if parts:
            yield from flush()

    return map_arrow(met, run, schema)
