"""The whole analysis as one plan: sources or spans, themes, findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicon as L
from ..config import DEFAULT, Settings
from ..operators import index as I
from ..operators import themes, verify
from ..sources import readers

VERSION = "0.6"
MODE = "MOCK (fully deterministic)"


def analyse(spans: DataFrame, theme_rows: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Findings of all themes (theme_id, theme) over spans, in one job. Hygiene columns that spans have are used."""
    index = I.index_for(spans, theme_rows, cfg)
    return verify.findings(theme_rows, I.retrieve(index, theme_rows, cfg=cfg), cfg)


def theme_table(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(names)), "theme_id int, theme string")


def run_pipeline(spark: SparkSession, sources: str | list[str], names: list[str] | None = None, auto_discover: bool = False, namer=None, cfg: Settings = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Loads sources, discovers themes if asked or if none are given, and analyses.

    Gives a one-row summary and the findings. Given themes win over discovered ones, which are still reported.
    """
    loaded = readers.load_sources(spark, [sources] if isinstance(sources, str) else list(sources), cfg)
    found: list[str] = []
    if (auto_discover or not names) and cfg.is_enabled("auto_theme"):
        found = [r["theme"] for r in themes.discover_themes(loaded.chunks, cfg=cfg, namer=namer).orderBy("theme_id").collect()]
    chosen = names or found
    table = theme_table(spark, chosen)
    out = analyse(loaded.spans, table, cfg).withColumn("source_document", F.array(*(F.lit(n) for n in loaded.names)))
    return summary(loaded.chunks, loaded.names, chosen, found, "HYBRID (LLM themes + deterministic engine)" if namer else MODE), out


def summary(chunks: DataFrame, names: list[str], chosen: list[str], found: list[str], mode: str = MODE) -> DataFrame:
    listed = lambda a: F.array(*(F.lit(x) for x in a)).cast("array<string>")
    return chunks.agg(F.count(F.lit(1)).alias("chunk_count")).select(
        F.lit(VERSION).alias("version"), F.lit(mode).alias("mode"), listed(names).alias("source_document"), F.lit(len(names)).alias("document_count"),
        "chunk_count", F.lit(len(chosen)).alias("themes_analysed"), listed(found).alias("discovered_themes"),
    )


def partition_by_status(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Supported (verified, partial, weak, conflicting) and blocked findings."""
    supported = F.col("status").isin(*L.SUPPORTED)
    return findings.filter(supported), findings.filter(~supported)


def status_styles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, *v) for s, v in L.STATUS_STYLE.items()], "status string, icon string, color string, background string")
