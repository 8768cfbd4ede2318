"""Substring dedup by unit hashing: lines, split further at sentence ends.

A short line has a digest of its own as well, for it goes only where it repeats as a line. Units are normalised and hashed; digests are grouped over all documents; the occurrence in the
earliest ranked document stays, the others go, and their original offsets are kept. Only digests and
ids are shuffled for the search; a digest that stands in a third of all documents is combined before
the shuffle, and the join back leaves it to the runtime's skew split.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .shared import map_arrow, without_columns, written

BREAK = re.compile(r"(?<=[.!?。！？])\s+|(?<!\s)[^\S\n]*+\n\s*")  # each run of white space is read once
# Ends of sentences in scripts that write no space after them, and what may close a quotation behind one.
WIDE_END, WIDE_CLOSE = "。！？｡။។", "」』”’）】"
WIDE = re.compile(f"[{WIDE_END}]")
WIDE_BREAK = re.compile(
    rf"{BREAK.pattern}|(?:(?<=[{WIDE_END}])|(?<=[{WIDE_END}][{WIDE_CLOSE}]))(?:\s+|(?![\s{WIDE_END}{WIDE_CLOSE}]))"
)
# Scripts without spaces between words: two code points of Han and kana, or four of the others, count as a word.
HAN = re.compile("[\u3041-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U0001b000-\U0001b16f\U00020000-\U000323af]")
THAI = re.compile("[\u0e01-\u0eff\u0f00-\u109f\u1780-\u17ff\u1950-\u19df\u1a20-\u1aaf\ua9e0-\ua9ff\uaa60-\uaadf]")
LINE_SEED = 1
NO_ID = 2**63 - 1
SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))


def units(text: str) -> list[tuple[int, int, bytes, int]]:
    """(start, end, digest, words) of each unit that has a word; ends leave out the break.

    Code points of scripts without spaces count as words by their number if that gives more.
    """
    found = []
    at = 0
    dense = [(p, n) for p, n in ((HAN, 2), (THAI, 4)) if not text.isascii() and p.search(text)]
    breaks = WIDE_BREAK if not text.isascii() and WIDE.search(text) else BREAK
    for cut in [*breaks.finditer(text), None]:
        end = cut.start() if cut else len(text)
        if words := text[at:end].lower().split():
            size = max(len(words), sum(len(p.findall(text, at, end)) // n for p, n in dense))
            found.append((at, end, xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass")), size))
        if cut:
            at = cut.end()
    return found


def short_lines(text: str, parts: list[tuple[int, int, bytes, int]], min_words: int) -> list[tuple[int, int, bytes]]:
    """(first unit, unit after the last, digest) of each line of fewer than ``min_words`` words.

    Longer lines need none: all their units repeat, so they make a run that is long enough.
    """
    found, first = [], 0
    for i in range(1, len(parts) + 1):
        if i == len(parts) or text.find("\n", parts[i - 1][1], parts[i][0]) >= 0:
            if sum(p[3] for p in parts[first:i]) < min_words:
                line = " ".join(text[parts[first][0] : parts[i - 1][1]].lower().split())
                found.append((first, i, xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"), LINE_SEED)))
            first = i
    return found


def repeated_spans(text: str, elsewhere: set[bytes], min_words: int) -> list[tuple[int, int]]:
    """Spans of ``text`` to remove, each up to the start of what follows.

    A unit counts as repeated if its digest is in ``elsewhere`` or an equal unit stands before it in
    the text. A run of repeated units goes if it has ``min_words`` words or more. A line of fewer goes
    if it repeats as a whole line.
    """
    parts = units(text)
    seen: set[bytes] = set()
    gone = [False] * (len(parts) + 1)
    run, run_words = 0, 0
    for i, (_, _, digest, words) in enumerate([*parts, (0, 0, b"", 0)]):
        if i < len(parts) and (digest in elsewhere or digest in seen):
            run_words += words
        else:
            if run_words and run_words >= min_words:
                gone[run:i] = [True] * (i - run)
            run, run_words = i + 1, 0
        seen.add(digest)
    for first, after, digest in short_lines(text, parts, min_words):
        if digest in elsewhere or digest in seen:
            gone[first:after] = [True] * (after - first)
        seen.add(digest)
    spans, start = [], None
    for i, out in enumerate(gone):
        if out and start is None:
            start = parts[i][0]
        elif not out and start is not None:
            spans.append((start, parts[i][0] if i < len(parts) else len(text)))
            start = None
    return spans


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without ``spans``; white space that a removed end leaves behind goes too."""
    if not spans:
        return text
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at:start])
        at = end
    out = "".join(kept) + text[at:]
    return out.rstrip() if at == len(text) else out


def unit_digests(docs: DataFrame, min_words: int) -> DataFrame:
    """(rank, key, d1, d2) for each different unit and short line of each row of ``docs`` (rank, key, text)."""

    def extract(batches):
        for batch in batches:
            digests, counts = [], []
            for value in batch.column(2):
                body = value.as_py() or ""
                parts = units(body)
                own = {u[2] for u in parts} | {x[2] for x in short_lines(body, parts, min_words)}
                digests.extend(own)
                counts.append(len(own))
            pairs = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            own_row = [np.repeat(batch.column(k).to_numpy(zero_copy_only=False), counts) for k in (0, 1)]
            columns = [*own_row, pairs[:, 0], pairs[:, 1]]
            yield [pa.array(np.ascontiguousarray(c)) for c in columns]

    return map_arrow(docs, extract, StructType([StructField(n, LongType()) for n in ("rank", "key", "d1", "d2")]))


def substring_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", min_words: int = 8) -> DataFrame:
    """``docs`` with repeated units taken out of ``text`` and their places in ``removed``.

    ``removed`` holds the spans (start, end) in code points of the original text; it is empty for a
    row that lost nothing. Units are compared in lower case with white space made one space. The
    document with the smallest id keeps a unit, and within a document the first place does. Rows that
    repeat an id rank alike and are treated alike; null ids rank last, alike. A null text stays null.
    A text may become empty; no row is dropped. Whole repeated lines go however short. Inside a line
    that does not repeat, runs of fewer than ``min_words`` repeated words stay, so that short sentences
    which recur by chance do not cost it anything.
    """
    docs = without_columns(docs, "removed", "__rank", "__key", "__found")
    names = docs.columns
    rank = F.coalesce(F.col(f"`{id}`").cast("bigint"), F.lit(NO_ID))
    # Rows that share a rank, such as all without an id, share a list of hits only if their texts are equal, too.
    key = F.xxhash64(F.col(f"`{text}`"))
    found = written(unit_digests(docs.select(rank.alias("rank"), key.alias("key"), F.col(f"`{text}`").alias("text")), min_words), "substring-digests")
    first = found.groupBy("d1", "d2").agg(F.min("rank").alias("first"), F.max("rank").alias("last"))
    repeated = first.where("last > first").select("d1", "d2", "first")
    hits = found.join(repeated, ["d1", "d2"]).where("rank > first").select("rank", "key", "d1", "d2").distinct()
    per_text = written(hits.groupBy("rank", "key").agg(F.collect_list(F.struct("d1", "d2")).alias("__found")), "substring-hits")
    joined = docs.withColumn("__rank", rank).withColumn("__key", key)
    joined = joined.join(per_text.toDF("__rank", "__key", "__found"), ["__rank", "__key"], "left")
    schema = StructType([*docs.schema.fields, StructField("removed", SPANS)])
    place = names.index(text)
    spans_arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def apply(batches):
        for batch in batches:
            texts, removed = [], []
            lists = batch.column(len(names))
            pairs = lists.flatten()
            flat = np.ascontiguousarray(np.stack([pairs.field(k).to_numpy(zero_copy_only=False) for k in (0, 1)], axis=1)).astype(np.int64)
            sizes = np.fromiter((0 if not x.is_valid else len(x) for x in lists), np.int64, len(lists))
            ends = np.cumsum(sizes)
            for value, size, end in zip(batch.column(place), sizes.tolist(), ends.tolist(), strict=True):
                body = value.as_py()
                own = flat[end - size : end].tobytes()
                elsewhere = {own[k : k + 16] for k in range(0, len(own), 16)}
                spans = repeated_spans(body, elsewhere, min_words) if body else []
                texts.append(None if body is None else without(body, spans))
                removed.append([{"start": a, "end": b} for a, b in spans])
            columns = list(batch.columns[: len(names)])
            columns[place] = pa.array(texts, pa.string())
            yield [*columns, pa.array(removed, spans_arrow)]

    return map_arrow(joined.select(*[F.col(f"`{c}`") for c in names], "__found"), apply, schema)
