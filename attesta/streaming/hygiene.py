"""Hygiene on a stream of spans, and themes scored per micro-batch.

Cleaning, eligibility, typing and polarity need no state, so they run on a stream as they do on a table.
Retrieval needs totals of the whole corpus; find_in_stream scores each micro-batch against a saved index's
frequencies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULT, Settings
from ..operators import index as I
from ..operators import segment
from ..tables import mark, release


def clean_stream(spans: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    return segment.with_hygiene(spans, cfg)


def type_counts(spans: DataFrame, time_col: str = "ts", every: str = "10 minutes", late: str = "1 hour", cfg: Settings = DEFAULT) -> DataFrame:
    """Eligible spans by evidence type and time window; rows later than ``late`` are dropped by the watermark."""
    rows = segment.with_hygiene(spans.withWatermark(time_col, late), cfg).filter("eligible")
    return rows.groupBy(F.window(time_col, every), "evidence_type").agg(F.count(F.lit(1)).alias("n"))


def find_in_stream(spans: DataFrame, terms_path: str, themes: list[tuple[int, str]], out: str, checkpoint: str, cfg: Settings = DEFAULT) -> StreamingQuery:
    """Writes candidates of each micro-batch, weighted by the document frequencies saved at ``terms_path``."""

    def batch(df: DataFrame, epoch: int) -> None:
        spark: SparkSession = df.sparkSession
        staged = mark()
        table = spark.createDataFrame(themes, "theme_id int, theme string")
        terms = spark.read.parquet(terms_path)
        rows = segment.with_hygiene(df, cfg)
        postings = I.term_counts(rows, "span_seq", cfg=cfg).join(terms, "term").select("span_seq", "term", "tf", (F.col("tf") * F.col("idf")).alias("w"))
        norms = postings.groupBy("span_seq").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("nrm"))
        found = I.retrieve(I.Index(rows, postings, terms, norms), table, cfg=cfg)
        found.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        release(spark, staged)

    return spans.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
