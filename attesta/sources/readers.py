"""Readers: every format becomes chunks and spans. Files are read by Spark, so any path it knows will do.

The table-shaped entry points take DataFrames: ``from_texts`` for documents, ``from_html`` for fetched
pages, ``segment.tabular`` for rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import text as T
from ..functions.folds import pages_by_size
from ..operators import segment
from ..shipping import ship
from ..tables import materialize
from . import office
from .fetch import fetched
from .records import cells_of, csv_records, file_key, records_of

TEXT, TABLE, SHEET = (".txt", ".md", ".text"), (".csv", ".tsv"), (".xlsx", ".xls")


@dataclass
class Loaded:
    chunks: DataFrame
    spans: DataFrame
    names: list[str]
    failures: DataFrame


def tag_of(name: str) -> str:
    """Short tag of a file name or URL; the Python twin of functions.text.safe_tag."""
    base = name.rsplit("/", 1)[-1]
    stem = re.sub(r"(?<=[^.])\.[^.]*\Z", "", base).lower()
    return re.sub("[^a-z0-9]+", "", stem)[:8] or "doc"


def from_texts(docs: DataFrame, ord_col: str, name_col: str, text_col: str, tag_col: str | None = None, cfg: Settings = DEFAULT) -> DataFrame:
    """Documents (source_ord, source_document, doc_tag, pages) of a table with a text in each row."""
    tag = F.col(tag_col) if tag_col else T.safe_tag(F.col(name_col).cast("string"))
    return docs.select(F.col(ord_col).cast("long").alias("source_ord"), F.col(name_col).cast("string").alias("source_document"), tag.alias("doc_tag"), pages_by_size(F.col(text_col), cfg).alias("pages"))


def from_html(pages: DataFrame, ord_col: str = "page_id", url_col: str = "url", html_col: str = "html", cfg: Settings = DEFAULT) -> DataFrame:
    """Documents of fetched web pages. Their text has no blank lines, so each is one page, form feeds or not."""
    tag = T.safe_tag(F.regexp_replace(F.col(url_col), "https?://", ""))
    text = pages.select(F.col(ord_col).cast("long").alias("source_ord"), F.col(url_col).alias("source_document"), tag.alias("doc_tag"), T.html_text(F.col(html_col)).alias("_t"))
    return text.select("source_ord", "source_document", "doc_tag", pages_by_size(F.col("_t"), cfg, ascii_only=True).alias("pages"))


def paragraph_pages(paragraphs: Column, per_page: int) -> Column:
    """Pages of so many paragraphs each, joined by blank lines."""
    starts = F.when(F.size(paragraphs) > 0, F.sequence(F.lit(1), F.size(paragraphs), F.lit(per_page))).otherwise(F.array(F.lit(1)))
    return F.transform(starts, lambda i: F.array_join(F.slice(paragraphs, i, F.lit(per_page)), "\n\n"))


# --- one file's bytes, inside a task: rows of (text, parts, row number, columns, cells) ------------------


def _read_text(data: bytes) -> Iterator[tuple]:
    """Bytes that aren't UTF-8 are dropped."""
    yield data.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n"), None, None, None, None


def _read_docx(data: bytes) -> Iterator[tuple]:
    yield None, office.docx_paragraphs(data), None, None, None


def _read_pdf(data: bytes) -> Iterator[tuple]:
    import fitz

    with fitz.open(stream=data, filetype="pdf") as pdf:
        yield None, [p.get_text("text") for p in pdf], None, None, None


def _read_sheet(data: bytes) -> Iterator[tuple]:
    """Rows of the first sheet under its header; a column without a name gets one."""
    rows = office.xlsx_rows(data)
    columns = [h if h is not None else f"Unnamed: {i}" for i, h in enumerate(rows[0] if rows else [])]
    for n, row in enumerate(rows[1:], 1):
        yield None, None, n, columns, [*row, *[None] * len(columns)][: len(columns)]


_DECODERS = {"text": _read_text, "docx": _read_docx, "pdf": _read_pdf, "sheet": _read_sheet}
_DECODED = "source_ord long, kind string, text string, parts array<string>, _row_number long, columns array<string>, cells array<string>, error string"
#: Rows handed to Arrow at once, of tables and files.
_BATCH = 1000


def _decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """source_ord, kind, content of files: what they hold, or why they can't be read."""
    names = [f.split()[0] for f in _DECODED.split(", ")]
    for part in parts:
        out: list[tuple] = []
        for at, kind, data in zip(part["source_ord"], part["kind"], part["content"], strict=True):
            begun = len(out)
            try:
                for row in _DECODERS[kind](bytes(data)):
                    out.append((at, kind, *row, None))
            except Exception as e:  # whatever a broken file makes its parser raise becomes that file's row
                out[begun:] = [(at, kind, *[None] * 5, f"{type(e).__name__}: {e}")]
            while len(out) >= _BATCH:
                yield pd.DataFrame(out[:_BATCH], columns=names).astype({"_row_number": "Int64"})
                del out[:_BATCH]
        if out:
            yield pd.DataFrame(out, columns=names).astype({"_row_number": "Int64"})


def _from_decoded(rows: DataFrame, cfg: Settings) -> list[tuple[DataFrame, DataFrame]]:
    """Chunks and spans of decoded files: documents, and rows of tables."""
    pages = F.when(F.col("kind") == "text", pages_by_size(F.col("text"), cfg)).when(F.col("kind") == "docx", paragraph_pages(F.col("parts"), cfg.docx_paragraphs)).otherwise(F.col("parts"))
    good = rows.filter("error is null")
    made = segment.chunks(good.filter("kind <> 'sheet'").select(*_HEAD, pages.alias("pages"), "kind"), cfg, ["kind"])
    spans = segment.spans(made, F.col("kind") == "pdf", cfg, ["kind"])
    return [(made.drop("kind").withColumn("record_type", F.lit(None).cast("string")), spans.drop("kind")), segment.records(good.filter("kind = 'sheet'"))]


# --- tables -------------------------------------------------------------------------------------------

_CSV = {"quote": '"', "escape": '"', "multiLine": "true"}
_HEAD = ["source_ord", "source_document", "doc_tag"]


def _read_table(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """read_csv; tab-separated files use tabs."""
    return read_csv(spark, path, _sep(path))


def _sep(path: str) -> str:
    return "\t" if path.lower().endswith(".tsv") else ","


def read_csv(spark: SparkSession, path: str, sep: str) -> tuple[list[str], DataFrame]:
    """The columns of a table with a header, and its rows with _row_number from 1: of a folder, its parts' in the order they are
    read. One file is read by many tasks (records); a folder, and a file whose quotes only a reader from the start can follow,
    by one task a file."""
    options = {**_CSV, "sep": sep}
    df = spark.read.options(**options, header="true").csv(path)
    records = csv_records(spark, path, sep) if df.columns and len(df.inputFiles()) == 1 else None
    if records is None:
        return df.columns, row_numbers(df)
    parsed = records.filter("_row_number > 0").select("_row_number", F.from_csv("record", df.schema.toDDL(), options).alias("r"))
    return df.columns, parsed.select("_row_number", "r.*")


def row_numbers(df: DataFrame) -> DataFrame:
    """``df``, written once, with _row_number from 1: a row's place in its partition after the counts of those before."""
    fixed = materialize(df.withColumn("_at", F.monotonically_increasing_id()))
    # Fixed by Spark: a partition's ids start at its number times 2 ** 33
    part = F.shiftright("_at", 33)
    counts = fixed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    starts = materialize(counts.select("_part", before.alias("_before")))
    placed = fixed.join(starts, part == F.col("_part"))
    return placed.withColumn("_row_number", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before") + 1).drop("_at", "_part", "_before")


def _read_url(urls: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Decoded rows of pages (source_ord, url), fetched on executors."""
    kept = fetched(urls, cfg)
    return kept.select("source_ord", F.lit("text").alias("kind"), T.html_text(F.col("html")).alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in (x.split() for x in _DECODED.split(", ")[3:7])), "error")


def reader_of(source: str, cfg: Settings = DEFAULT):
    """The reader for a path or URL, by its scheme or extension; formats can be switched off."""
    low = source.lower()
    ext = "." + low.rsplit("/", 1)[-1].rsplit(".", 1)[-1] if "." in low.rsplit("/", 1)[-1] else ""
    table = (
        (low.startswith(("http://", "https://")), "input_url", "URL", _read_url),
        (ext == ".pdf", None, "PDF", _read_pdf),
        (ext == ".docx", "input_docx", "DOCX", _read_docx),
        (ext in TEXT, None, "Text", _read_text),
        (ext in TABLE, "input_csv", "CSV", _read_table),
        (ext in SHEET, "input_xlsx", "Excel", _read_sheet),
    )
    for fits, flag, label, read in table:
        if fits:
            if flag and not cfg.is_enabled(flag):
                raise ValueError(f"{label} input is disabled.")
            return read
    raise ValueError(f"Unsupported input type: {source} (ext '{ext}'). Supported: .pdf, .docx, .txt, .md, .text, .csv, .tsv, .xlsx, .xls, or http(s) URL.")


def _keys(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths in full, as records.file_key has them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folders: dict[str, str] = {}
    out = []
    for path in paths:
        above, slash, name = path.rpartition("/")
        if above not in folders:
            folder = jvm.org.apache.hadoop.fs.Path(above or slash or ".")
            folders[above] = folder.getFileSystem(conf).makeQualified(folder).toString().rstrip("/")
        out.append(re.sub("^file:/*", "file:/", f"{folders[above]}/{name}"))
    return out


_KINDS = {_read_text: "text", _read_docx: "docx", _read_pdf: "pdf", _read_sheet: "sheet", _read_table: "csv", _read_url: "url"}


def load_sources(spark: SparkSession, sources: list[str], cfg: Settings = DEFAULT, strict: bool = True) -> Loaded:
    """All sources pooled, in order, with unique tags.

    However many they are: one scan of all files but tables, one of all comma- and one of all tab-separated tables, one fetch of
    all pages. Scans are cut by bytes, so small files share tasks. Only folders and patterns, and tables with odd quotes, take a
    branch of the plan each. What is decoded is written once, for chunks and spans.

    A file that can't be parsed and a page that can't be fetched are rows of ``failures``; strict raises if there are any. A path
    without a file is an error at once. A source given twice is there twice.
    """
    ship(spark)
    bases = [tag_of(re.sub("https?://", "", s)) for s in sources]
    tags = segment.unique_tags(bases) if len(sources) > 1 else bases
    names = [s if s.lower().startswith(("http://", "https://")) else s.rsplit("/", 1)[-1] for s in sources]
    kinds = [_KINDS[reader_of(s, cfg)] for s in sources]
    if "pdf" in kinds:
        try:
            import fitz  # noqa: F401
        except ImportError as e:
            raise ValueError("PDF input needs the optional library PyMuPDF on the cluster.") from e
    keys = [s if k == "url" else "" for s, k in zip(sources, kinds, strict=True)]
    local = [i for i, k in enumerate(kinds) if k != "url"]
    for i, key in zip(local, _keys(spark, [sources[i] for i in local]), strict=True):
        keys[i] = key
    heads = spark.createDataFrame(list(zip(range(len(sources)), names, tags, kinds, keys, strict=True)), "source_ord long, source_document string, doc_tag string, kind string, file string")
    plain = heads.filter("kind <> 'url'")
    if local:
        listed = spark.read.format("binaryFile").load(sorted({sources[i] for i in local})).select(file_key().alias("file")).distinct()
        several = {r["source_ord"] for r in plain.join(listed, "file", "left_anti").select("source_ord").collect()}  # of the given sources
    else:
        several = set()
    whole = lambda *ks: sorted({sources[i] for i in local if kinds[i] in ks and i not in several})

    decoded: list[DataFrame] = []
    files = lambda paths: spark.read.format("binaryFile").load(paths).select("content", file_key().alias("file"))
    run = lambda df: df.select("source_ord", "kind", "content").mapInPandas(_decode, _DECODED)
    if paths := whole("text", "docx", "pdf", "sheet"):
        decoded.append(run(files(paths).join(plain.filter("kind <> 'csv'"), "file")))
    decoded += [run(files([sources[i]]).withColumns({"source_ord": F.lit(i).cast("long"), "kind": F.lit(kinds[i])})) for i in sorted(several) if kinds[i] != "csv"]
    if "url" in kinds:
        decoded.append(_read_url(heads.filter("kind = 'url'").select("source_ord", F.col("file").alias("url")), cfg))
    parts: list[tuple[DataFrame, DataFrame]] = []
    failures = spark.createDataFrame([], "source_ord long, source_document string, error string")
    if decoded:
        rows = materialize(reduce(DataFrame.unionByName, decoded)).join(heads.select(*_HEAD), "source_ord")
        failures = rows.filter("error is not null").select("source_ord", "source_document", "error")
        if strict and (first := failures.orderBy("source_ord").limit(3).collect()):
            raise ValueError("Sources that can't be read: " + "; ".join(f"{r['source_document']}: {r['error']}" for r in first))
        parts += _from_decoded(rows, cfg)

    single = sorted(i for i in several if kinds[i] == "csv")
    for sep in (",", "\t"):
        if paths := [p for p in whole("csv") if _sep(p) == sep]:
            records, odd = records_of(spark, paths, sep)
            single += [i for i in local if keys[i] in odd and kinds[i] == "csv" and i not in several]
            fine = records.filter(~F.col("file").isin(odd)) if odd else records
            parts.append(segment.records(cells_of(fine, sep, {**_CSV, "sep": sep}).join(heads.filter("kind = 'csv'").select("file", *_HEAD), "file")))
    for i in sorted(single):
        columns, rows = _read_table(spark, sources[i])
        parts.append(segment.tabular(rows.withColumns({"source_ord": F.lit(i).cast("long"), "source_document": F.lit(names[i]), "doc_tag": F.lit(tags[i])}), columns, "_row_number"))
    pool = lambda k: reduce(lambda a, b: a.unionByName(b), (p[k] for p in parts))
    return Loaded(pool(0), pool(1), names, failures)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """Spans of a chunk-and-span index file in JSON."""
    doc = spark.read.json(path, multiLine=True).select(F.posexplode("chunks").alias("c", "chunk"))
    each = doc.select("c", "chunk", F.posexplode("chunk.spans").alias("s", "span"))
    seq = F.struct(F.lit(0).cast("long").alias("source_ord"), F.col("c").cast("long").alias("chunk_no"), F.col("s").cast("long").alias("span_no"))
    return each.select(seq.alias("span_seq"), "span.span_id", "span.text", "chunk.chunk_id", F.col("chunk.page_number").cast("int").alias("page_number"), "chunk.source_document")


def save_index(chunks: DataFrame, spans: DataFrame, path: str) -> None:
    """Chunks with nested spans, as JSON lines."""
    nested = spans.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("span_no", "span_id", "text"))).alias("s"))
    nested = nested.select("chunk_id", F.transform("s", lambda x: F.struct(x["span_id"].alias("span_id"), x["text"].alias("text"))).alias("spans"))
    chunks.join(nested, "chunk_id", "left").write.mode("overwrite").json(path)
