"""From documents to packed sequences: five stages, each written and read again by the next.

``ORACLE_SQL`` is none: compression, fingerprint components and token ids are beyond SQL. Tests hold
every stage against brute force instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.llm import langid, packing, quality, simhash, substring
from millwright.llm.queries import TOKENIZER, fold
from millwright.llm.shared import same_columns, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outlier for their language and source."""
    return same_columns(quality.quality_rules(docs, by_language=True).where("kept"), docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told by more than a narrow margin."""
    known = langid.fit_dictionaries(docs.where(fold("doc_id", 5) != 0))
    return same_columns(langid.confident(docs, known), docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each fingerprint component."""
    return same_columns(simhash.simhash_dedup(docs, shingle=4, max_distance=4), docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the units that an earlier one has; ``n_chars`` follows the text."""
    found = substring.substring_dedup(docs).withColumn("n_chars", F.length("text").cast("bigint"))
    return same_columns(found, docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 1024 tokens."""
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("quality rules", quality_stage),
    ("language id", language_stage),
    ("near duplicates", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
