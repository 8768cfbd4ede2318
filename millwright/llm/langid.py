"""Language identification by compression with per-language zstandard raw-content dictionaries.

The letters and combining marks of the whole text in lower case, with one space for whatever stands between, are cut into
pieces, each is compressed with the dictionary of each language, and the smallest sum
wins. Pieces are short enough that a text is told by the dictionary and not by its own beginning. Dictionaries hold the words
that most sampled training documents of a language share, the most frequent at the end, where references to them are cheapest.
"""

from __future__ import annotations

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .shared import map_arrow, without_columns

SAMPLE_PER_LANGUAGE = 4000
WORDS_PER_LANGUAGE = 8000
DICTIONARY_BYTES = 32768
LEVEL = 12
PIECE_BYTES = 1024
CODERS_AT_ONCE = 64
LISTED_LANGUAGES = 200
UNKNOWN = "und"
NARROW = 0.003

NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")

# Scripts without spaces: runs of so many code points stand for words.
UNSPACED = [(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]{2}", "$0 "), (r"[\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]{4}", "$0 ")]


def fit_dictionaries(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    sample: int = SAMPLE_PER_LANGUAGE,
    size: int = DICTIONARY_BYTES,
) -> dict[str, bytes]:
    """Dictionary of each language, the most frequent language first.

    Learns from about ``sample`` rows of each language (a bounded sample of labelled rows, drawn by a
    hash of the id), whole texts. Rows without text or language teach nothing. There may be any number of
    languages; the driver holds ``size`` bytes of each, and each is one compression per text.
    """
    rows = docs.where(F.col(f"`{text}`").isNotNull() & F.col(f"`{lang}`").isNotNull()).select(
        F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")
    )
    counts = [(r["lang"], r["count"]) for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()]
    if not counts:
        return {}
    # Languages beyond the listed ones are no more frequent than the last of these, whose share serves them.
    listed = counts[:LISTED_LANGUAGES]
    shares = F.create_map(*[x for k, n in listed for x in (F.lit(k), F.lit(min(1.0, sample / n)))])
    share = F.coalesce(shares[F.col("lang")], F.lit(min(1.0, sample / listed[-1][1])))
    chance = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    letters = F.regexp_replace(F.lower("text"), "[^\\p{L}\\p{M}]+", " ")
    for run, spaced in UNSPACED:
        letters = F.regexp_replace(letters, run, spaced)
    words = rows.where(chance < share).select("lang", F.explode(F.array_distinct(F.split(letters, " "))).alias("word"))
    ranked = words.where("word <> ''").groupBy("lang", "word").count()
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))
    top = ranked.withColumn("place", place).where(F.col("place") <= WORDS_PER_LANGUAGE)
    content = F.concat_ws(" ", F.sort_array(F.collect_list(F.struct((-F.col("place")).alias("at"), "word")))["word"])
    learned = {r["lang"]: r["content"] for r in top.groupBy("lang").agg(F.right(content, F.lit(size)).alias("content")).collect()}
    return {language: f" {learned.get(language, '')} ".encode()[-size:] for language, _ in counts}


def coder(content: bytes, level: int) -> zstandard.ZstdCompressor:
    known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False)


def pieces(text: str | None) -> list[bytes]:
    """All letters of a text in lower case, repeats included, in pieces; none if it has no letter."""
    if not text or not any(map(str.isalpha, text)):
        return []
    data = NOT_LETTERS.sub(" ", f" {text.lower()} ").encode("utf-8", "surrogatepass")
    return [data[at : at + PIECE_BYTES] for at in range(0, len(data), PIECE_BYTES)]


class Identifier:
    """Chooses the language whose dictionary compresses a text best.

    Any number of languages: coders of ``at_once`` of them exist at a time, and of every text the two
    smallest sizes so far are carried along.
    """

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL, at_once: int = CODERS_AT_ONCE):
        self.dictionaries, self.level, self.at_once = list(dictionaries.items()), level, at_once
        self.kept = self._coders(0) if len(dictionaries) <= at_once else None

    def _coders(self, at: int) -> list[tuple[str, zstandard.ZstdCompressor]]:
        return [(language, coder(content, self.level)) for language, content in self.dictionaries[at : at + self.at_once]]

    def choose(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text: the score is how much smaller the best result is than the next, 0 to 1.

        ``und`` with score 0 if the text is null or has no letter, or nothing was learned. With one
        language only the score is 1. Of equal sizes the language listed first wins, with score 0.
        """
        cut = [pieces(text) for text in texts]
        found: list[tuple[str, int, int | None] | None] = [None] * len(texts)
        for at in range(0, len(self.dictionaries), self.at_once):
            for language, one in self.kept or self._coders(at):
                for i, parts in enumerate(cut):
                    if not parts:
                        continue
                    size, now = sum(len(one.compress(p)) for p in parts), found[i]
                    if now is None:
                        found[i] = (language, size, None)
                    elif size < now[1]:
                        found[i] = (language, size, now[1])
                    elif now[2] is None or size < now[2]:
                        found[i] = (now[0], now[1], size)
        return [(UNKNOWN, 0.0) if f is None else (f[0], 1.0 if f[2] is None else 1.0 - f[1] / f[2]) for f in found]

    def __call__(self, text: str | None) -> tuple[str, float]:
        return self.choose([text])[0]


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` from the text alone; columns so named give way.

    A null text, an empty one and one without a letter are ``und`` with score 0. A text of any length counts whole.
    Rows map one to one; equal texts get equal results. Of languages that compress a text equally well the more frequent
    one wins, with score 0. Dictionaries travel with the function: ``DICTIONARY_BYTES`` a language.
    """
    docs = without_columns(docs, "lang_pred", "score")
    place = docs.columns.index(text)
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def predict(batches):
        choose = Identifier(dictionaries).choose
        for batch in batches:
            found = choose(batch.column(place).to_pylist())
            yield [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]

    return map_arrow(docs, predict, schema)


def confident(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", narrow: float = NARROW) -> DataFrame:
    """Rows of ``docs`` with a known language whose margin is not narrow, with the two new columns."""
    return identify(docs, dictionaries, text).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= narrow))
