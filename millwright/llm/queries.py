"""Registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, html_blocks, langid, lexical, lm, mixing, packing, quality, simhash, substring, warc, whitening

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id: str, folds: int) -> Column:
    return F.crc32(F.col(id).cast("string")) % folds


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics of every document and the verdict of the robust outlier test."""
    found = quality.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), carry_text=False, by_language=True)
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "outlier_distance"
    )


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, by a labeller taught on a bounded sample of them."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html_blocks.extract(pages, html_blocks.fit_labeller(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the units that an earlier one has, and the spans taken out."""
    return substring.substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "removed")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by a model of six folds of seven."""
    return lm.score(table(spark, sf_dir, "documents"), fold("doc_id", 7) == 2)


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the token ids of every document and of the text decoded from them."""
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), TOKENIZER)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth, among all."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.simhash_report(table(spark, sf_dir, "documents"), shingle=4, max_distance=4)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from four folds of five."""
    docs = table(spark, sf_dir, "documents")
    known = langid.fit_dictionaries(docs.where(fold("doc_id", 5) != 0))
    found = langid.identify(docs.select("doc_id", "text"), known)
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back through the capture index."""
    found = warc.archive_round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix of all sources takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2, keep=["doc_id"])


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return lexical.search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), k=10)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the four leading components, with unit variance."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=4)


OP10_SQL = """
    WITH payloads AS (
        SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
        FROM pages
    ), firsts AS (
        SELECT payload_digest, min(page_id) AS first_id FROM payloads WHERE payload_bytes >= 100 GROUP BY payload_digest
    )
    SELECT page_id, payload_bytes, payload_digest,
        CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN page_id > first_id THEN first_id END AS refers_to
    FROM payloads LEFT JOIN firsts USING (payload_digest)
"""

OP12_SQL = r"""
    WITH words AS (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM documents
    ), counts AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
    lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
    totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
    asked AS (
        SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark
    ), weights AS (
        SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
        FROM counts, totals GROUP BY term
    ), scores AS (
        SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score
        FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN lengths USING (doc_id), totals
        GROUP BY item_id, doc_id
    )
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
    FROM scores WHERE score > 0 QUALIFY rank <= 10
"""


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_quality_rules,
            op2_html_extraction,
            op3_substring_dedup,
            op4_lm_scoring,
            op5_bpe_round_trip,
            op6_packing,
            op7_nearest_neighbours,
            op8_simhash,
            op9_language_id,
            op10_warc,
            op11_source_mixing,
            op12_lexical_search,
            op13_embedding_whitening,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_warc": OP10_SQL, "op12_lexical_search": OP12_SQL}
