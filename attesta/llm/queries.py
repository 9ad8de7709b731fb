"""The numbered queries, each over its whole table, and their DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import ann, collocations, langid, license_scan, packing, pieces, pii, quality, resample, secret_scan, simhash, vector_dedup, warc
from .common import read


def _over(table: str, query: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(read(spark, sf_dir, table))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": _over("documents", packing.query),
    "op2_warc_revisits": _over("pages", warc.query),
    "op3_license_scan": _over("documents", license_scan.query),
    "op4_quality_rules": _over("documents", quality.query),
    "op5_sentencepiece": _over("documents", pieces.query),
    "op6_simhash": _over("documents", simhash.query),
    "op7_permutation_index": _over("embeddings", ann.query),
    "op8_personal_data": _over("documents", pii.query),
    "op9_language_id": _over("documents", langid.query),
    "op10_secret_scan": _over("documents", secret_scan.query),
    "op11_importance_resampling": resample.query,
    "op12_collocations": _over("documents", collocations.query),
    "op13_vector_dedup": _over("embeddings", vector_dedup.query),
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {"op2_warc_revisits": warc.ORACLE, "op12_collocations": collocations.ORACLE, "op13_vector_dedup": vector_dedup.ORACLE}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
