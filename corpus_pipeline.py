"""From raw documents to packed sequences: each stage works on all that the one before kept.

Every stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again
for the next. The stages before the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attesta.llm import langid, packing, quality, secret_scan, shingles
from attesta.llm.common import mark, new_folder, read, release


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the bounds of their language and source."""
    return quality.apply_rules(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that most of their letters are in."""
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: proposed by SimHash fingerprints and MinHash bands, with 0.8 of their 5-word shingles shared."""
    return shingles.drop_similar(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with credentials that aren't widely copied examples masked."""
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The boundary records of sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("secret scans", secret_scans),
    ("packing", pack),
]

#: Sketched bounds, a learned model and connected components aren't for SQL; tests/llm holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        path = new_folder(spark)
        before = mark()
        stage(spark, docs, sf_dir).write.parquet(path)
        release(spark, before)  # what the stage staged on its way
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
