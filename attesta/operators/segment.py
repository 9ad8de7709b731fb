"""Documents to chunks to spans, by arrays inside each document's row: no shuffle, no window.

documents: source_ord, source_document, doc_tag, pages (array of texts), and rows (array of cells) for tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import text as T
from ..functions.folds import chunk_texts
from ..tables import materialize


_SOURCE = ("source_ord", "source_document", "doc_tag")


def chunks(documents: DataFrame, cfg: Settings = DEFAULT, keep: Sequence[str] = (), ascii_only: bool = False) -> DataFrame:
    """source_ord, source_document, doc_tag, page_number, chunk_no, chunk_id, text, and columns to keep. Blank pages keep
    their numbers; chunks that are garbage have none. ascii_only: see functions.text.mode."""
    made = documents.withColumn("_c", chunk_texts(F.col("pages"), cfg, ascii_only))
    numbered = F.flatten(F.transform("_c", lambda page, i: F.transform(page, lambda c: F.struct((i + 1).alias("page_number"), c.alias("text")))))
    made = made.withColumn("_c", F.filter(numbered, lambda c: ~T.is_garbage(c["text"], cfg, ascii_only)))
    out = made.select(*_SOURCE, *keep, F.posexplode("_c").alias("_i", "_c"))
    return out.select(
        *_SOURCE, "_c.page_number", (F.col("_i") + 1).alias("chunk_no"),
        F.format_string("%s_c%04d", "doc_tag", F.col("_i") + 1).alias("chunk_id"), "_c.text", *keep,
    )


def _seq() -> Column:
    """A span's place: source, chunk and span, compared in this order. A struct, so that none can overflow."""
    return F.struct(*(F.col(c).cast("long").alias(c) for c in ("source_ord", "chunk_no", "span_no"))).alias("span_seq")


def spans(chunked: DataFrame, cleaned: bool | Column = False, cfg: Settings = DEFAULT, keep: Sequence[str] = ()) -> DataFrame:
    """A row per sentence of each chunk, as stored. cleaned: references are taken out first and stubs
    dropped before numbering, as for PDF pages. A column says it for each row."""
    sents = T.sentences(F.col("text"))
    if cleaned is not False:
        clean = F.filter(F.transform(sents, lambda s: T.clean_evidence(s, cfg)), lambda s: F.length(F.regexp_replace(s, r"\A[ .]+|[ .]+\z", "")) >= 3)
        sents = clean if cleaned is True else F.when(cleaned, clean).otherwise(sents)
    out = chunked.select("source_ord", "source_document", "doc_tag", "page_number", "chunk_no", "chunk_id", *keep, F.posexplode(sents).alias("_i", "text"))
    out = out.withColumn("span_no", F.col("_i") + 1).drop("_i")
    return out.withColumn("span_id", F.format_string("%s_s%02d", "chunk_id", "span_no")).withColumn("span_seq", _seq())


def tabular(rows: DataFrame, columns: list[str], row_number: str = "row_number") -> tuple[DataFrame, DataFrame]:
    """Chunks and spans of one table: a row is a chunk, a cell that isn't missing a span numbered by its column.

    rows: source_ord, source_document, doc_tag, a row number and the columns. Cells keep their literal text.
    """
    cells = F.array(*(F.col(f"`{c}`").cast("string") for c in columns))
    return records(rows.select(*_SOURCE, F.col(row_number).alias("_n"), F.lit(columns).cast("array<string>").alias("columns"), cells.cast("array<string>").alias("cells")), "_n")


def records(rows: DataFrame, row_number: str = "_row_number") -> tuple[DataFrame, DataFrame]:
    """tabular() for rows of many tables: columns (names) and cells are arrays of one length."""
    parts = F.transform("cells", lambda c, i: F.struct((i + 1).alias("span_no"), F.concat(F.get("columns", i), F.lit(": "), c).alias("text")))
    kept = rows.select(*_SOURCE, F.col(row_number).cast("int").alias("chunk_no"), F.filter(parts, lambda p: p["text"].isNotNull()).alias("_p"))
    kept = kept.filter(F.size("_p") > 0).withColumn("page_number", F.col("chunk_no")).withColumn("chunk_id", F.format_string("%s_r%04d", "doc_tag", "chunk_no"))
    base = [*_SOURCE, "page_number", "chunk_no", "chunk_id"]
    text = T.trim(F.array_join(F.transform("_p", lambda p: p["text"]), " | "))
    chunked = kept.select(*base, text.alias("text"), F.lit("row").alias("record_type"))
    cells = kept.select(*base, F.explode("_p").alias("_p")).select(*base, T.trim(F.col("_p.text")).alias("text"), F.col("_p.span_no"))
    return chunked, cells.withColumn("span_id", F.format_string("%s_s%02d", "chunk_id", "span_no")).withColumn("span_seq", _seq())


def with_verdict(texts: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """clean_text and eligible of every text: what needs no more than the text."""
    out = texts.withColumn("clean_text", T.clean_evidence(F.col("text"), cfg))
    return out.withColumn("eligible", T.is_eligible(F.col("clean_text"), cfg))


def with_hygiene(span_rows: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """clean_text, eligible, evidence_type and polarity of every span, once for all themes. Works on streams."""
    return with_verdict(span_rows, cfg).withColumns({
        "evidence_type": T.evidence_type(F.col("clean_text"), F.col("source_document")),
        "polarity": T.polarity(F.col("clean_text")),
    })


def numbered(rows: DataFrame, group: str, order: list[str], name: str = "place") -> DataFrame:
    """Adds the row number, from 0, in its group. Rows are dealt by ranges and numbered where they are; a group that
    reaches over several parts goes on from the count of the parts before."""
    dealt = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    fixed = materialize(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    parts = fixed.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = materialize(parts.select(F.col(group).alias("_group"), F.col("_part").alias("_p"), "_first", before.alias("_before")))
    joined = fixed.join(parts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn(name, F.col("_at") - F.col("_first") + F.col("_before")).drop("_part", "_at", "_group", "_p", "_first", "_before")


def unique_tags(bases: list[str]) -> list[str]:
    """The tags in order, made unique by 2, 3, ... at the end. Over a list of sources, not rows."""
    used: dict[str, None] = {}
    for base in bases:
        names = (base if n == 1 else f"{base}{n}" for n in range(1, len(used) + 2))
        used[next(x for x in names if x not in used)] = None
    return list(used)
