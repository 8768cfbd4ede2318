"""BPE encoding by dynamic programming over prefixes, and decoding.

An automaton over the vocabulary lists, at every byte, the tokens that end there (its suffix links).
The encoding of a prefix ends in exactly one token: the only match whose predecessor, the last token
of the shorter prefix, is compatible with it. Two tokens are compatible if merging their bytes
from scratch gives the two back. Following the last tokens backwards from the end gives the ids.
"""

from __future__ import annotations

from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .shared import map_arrow, without_columns
from .tokens import PIECES, vocabulary

NEVER = 1 << 62
MOST_KNOWN = 200_000


class PrefixEncoder(dict):
    """Maps a piece of text to its ids as int32 bytes; pieces met before are looked up.

    The lookup holds the last one to two times ``MOST_KNOWN`` different pieces, so memory is bounded.
    """

    def __init__(self, path: str):
        super().__init__()
        self.older: dict[str, bytes] = {}
        known = vocabulary(path)
        self.pattern = regex.compile(PIECES)
        self.ids = known.ids
        self.rank = {new: i for i, (_, _, new) in enumerate(known.merges)}
        self.parts = {new: (a, b) for a, b, new in known.merges}
        self.merged = {(a, b): i for i, (a, b, _) in enumerate(known.merges)}
        self.allowed: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token, i in known.ids.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), i))
        self.automaton.make_automaton()
        self.special = {t: np.int32(i).tobytes() for t, i in known.special.items()}
        names = sorted(map(regex.escape, self.special), key=len, reverse=True)
        self.cutter = regex.compile(f"({'|'.join(names)})") if names else None

    def compatible(self, left: int, right: int, but: int = NEVER) -> bool:
        """Whether no merge across the border comes before the merges that made the two tokens.

        The border is followed back in time: the later made of its two tokens is taken apart. A merge
        of the present two would have happened if its rank is below the rank that used up the left
        one, and not above the one that used up the right one (of equal ranks the first place wins).
        The merge of rank ``but`` is allowed.
        """
        used_left = used_right = NEVER
        while True:
            rank = self.merged.get((left, right), NEVER)
            if rank != but and rank < used_left and rank <= used_right and rank < NEVER:
                return False
            made_left, made_right = self.rank.get(left, -1), self.rank.get(right, -1)
            if made_left < 0 and made_right < 0:
                return True
            if made_left > made_right:
                used_left, left = made_left, self.parts[left][1]
            else:
                used_right, right = made_right, self.parts[right][0]

    def encode_piece(self, data: bytes) -> list[int]:
        """Ids of one piece: the last token of every prefix, then back from the end."""
        if (whole := self.ids.get(data)) is not None and self.whole(whole):
            return [whole]
        last = [-1] * (len(data) + 1)
        size = [0] * (len(data) + 1)
        allowed = self.allowed
        for end, (length, token) in self.automaton.iter(data.decode("latin-1")):
            end += 1
            if size[end]:
                continue
            before = last[end - length]
            if end == length:
                fits = self.whole(token)
            elif before < 0:
                continue
            else:
                fits = allowed.get((before, token))
                if fits is None:
                    if len(allowed) >= MOST_KNOWN:
                        allowed.clear()
                    fits = allowed[before, token] = self.compatible(before, token)
            if fits:
                last[end], size[end] = token, length
        ids, at = [], len(data)
        while at:
            ids.append(last[at])
            at -= size[at]
        return ids[::-1]

    def whole(self, token: int) -> bool:
        """Whether a token's own bytes encode to it: every part must come from compatible parts."""
        known = self.allowed.get((-1, token))
        if known is None:
            a, b = self.parts.get(token, (None, None))
            known = a is None or (self.whole(a) and self.whole(b) and self.compatible(a, b, self.rank[token]))
            self.allowed[-1, token] = known
        return known

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = array("i", self.encode_piece(piece.encode("utf-8", "surrogatepass"))).tobytes()
        if len(piece) <= 64:
            if len(self) >= MOST_KNOWN:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        """Ids of a text as int32 bytes; strings of special tokens become their ids."""
        if self.cutter is None or not any(t in text for t in self.special):
            return b"".join(map(self.__getitem__, self.pattern.findall(text)))
        out = []
        for part in self.cutter.split(text):
            out.append(self.special[part] if part in self.special else b"".join(map(self.__getitem__, self.pattern.findall(part))))
        return b"".join(out)


@lru_cache(maxsize=1)
def prefix_encoder(path: str) -> PrefixEncoder:
    """One encoder for all tasks that a Python worker runs, so later tasks find known pieces."""
    return PrefixEncoder(path)


class Decoder:
    """Maps ids to text; bytes that are no UTF-8 become U+FFFD, unknown ids nothing."""

    def __init__(self, path: str):
        known = vocabulary(path)
        self.table = [b""] * known.size
        for token, i in known.ids.items():
            self.table[i] = token
        for token, i in known.special.items():
            self.table[i] = token.encode()

    def __call__(self, ids: list[int]) -> str:
        table = self.table
        try:
            data = b"".join(map(table.__getitem__, ids))
        except (IndexError, TypeError):
            data = b"".join(table[i] for i in ids if i is not None and 0 <= i < len(table))
        return data.decode("utf-8", errors="replace")


def encode(docs: DataFrame, tokenizer: str, text: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with the token ids of its whole text in ``into``, an array of int.

    Ids equal those of the tokenizers library without special tokens added, truncation or padding. A
    null or empty text has no ids (an empty array). A column named as ``into`` gives way; rows,
    repeated ones included, map one to one.
    """
    docs = without_columns(docs, into)
    place = docs.columns.index(text)

    def run(batches):
        encoder = prefix_encoder(tokenizer)
        for batch in batches:
            found = [encoder(t.as_py() or "") for t in batch.column(place)]
            offsets = np.zeros(len(found) + 1, np.int32)
            np.cumsum([len(x) // 4 for x in found], out=offsets[1:])
            ids = np.frombuffer(b"".join(found), np.int32)
            yield [*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))]

    return map_arrow(docs, run, StructType([*docs.schema.fields, StructField(into, ArrayType(IntegerType()))]))


def decode(rows: DataFrame, tokenizer: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``rows`` with the text of ``ids`` in ``into``, special tokens included; null ids give null."""
    rows = without_columns(rows, into)
    place = rows.columns.index(ids)

    def run(batches):
        decoder = Decoder(tokenizer)
        for batch in batches:
            lists = batch.column(place)
            texts = [decoder(x.values.to_numpy(zero_copy_only=False).tolist()) if x.is_valid else None for x in lists]
            yield [*batch.columns, pa.array(texts, pa.string())]

    return map_arrow(rows, run, StructType([*rows.schema.fields, StructField(into, StringType())]))


def round_trip_digests(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n_tokens, and SHA-256 of the decimal ids joined by commas and of the decoded text."""
    coded = decode(encode(docs.select(F.col(f"`{id}`"), F.col(f"`{text}`")), tokenizer, text), tokenizer)
    return coded.select(
        F.col(f"`{id}`").alias(id),
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
