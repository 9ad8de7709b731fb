"""The records of CSV files, small or large, read by many tasks although cells may hold line breaks.

Lines are read by byte ranges as of any text. Whether a line starts inside a quoted cell depends on the quotes of all lines
of its file before: each range sums its own, a pass over these sums (a row a range) gives every range its start, and running sums
within a range place its lines. Records of one line, nearly all, stay where they are; only the lines of longer ones are brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import materialize

_MARK = "\u0001"


def file_key() -> Column:
    """The path of a row's file as Hadoop writes it, without escapes."""
    plain = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(plain, r"\Afile:/+", "file:/")


def _before(rows: DataFrame, value: str) -> DataFrame:
    """file, block, start: the sum of ``value`` over the ranges of the file before, of a row a range."""
    above = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return materialize(rows.select("file", "block", F.coalesce(F.sum(value).over(above), F.lit(0)).alias("start")))


def _flat(record: Column) -> Column:
    """A record with each quoted cell as one mark."""
    return F.regexp_replace(F.regexp_replace(record, _MARK, " "), '"[^"]*+"', _MARK)


def well_quoted(record: Column, sep: str) -> Column:
    """Whether quotes stand only around whole cells, doubled inside. A record's quotes are even in number."""
    return ~_flat(record).rlike(f"[^{sep}{_MARK}]{_MARK}|{_MARK}[^{sep}{_MARK}]")


def n_cells(record: Column, sep: str) -> Column:
    """Cells of a well-quoted record."""
    return F.size(F.split(_flat(record), sep, -1))


def records_of(spark: SparkSession, paths: list[str], sep: str) -> tuple[DataFrame, list[str]]:
    """file, _row_number (0: the header) and record of files, without empty lines; written. And the files whose quotes aren't
    those of whole cells: only a reader from their beginning can tell where records end, so their rows here mean nothing."""
    lines = spark.read.text(paths, lineSep="\n").select("value", file_key().alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    odd = F.pmod(F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))), F.lit(2))
    fixed = materialize(lines.withColumn("odd", odd))
    # A file's first line is in its first range. Its ending is the file's; within cells it becomes a line feed
    ends = F.min_by(F.endswith("value", F.lit("\r")), "at").alias("ends")
    sums = materialize(fixed.groupBy("file", "block").agg(F.sum("odd").alias("odd"), ends))
    open_ = [r["file"] for r in sums.groupBy("file").agg(F.sum("odd").alias("odd")).filter("odd % 2 = 1").collect()]  # of the given files
    here = Window.partitionBy("file", "block").orderBy("at")
    above = here.rowsBetween(Window.unboundedPreceding, -1)
    quoted = F.pmod(F.coalesce(F.sum("odd").over(above), F.lit(0)) + F.col("start"), F.lit(2)) == 1
    placed = fixed.join(_before(sums, "odd"), ["file", "block"]).withColumn("inside", quoted).drop("start")
    first = ~F.col("inside") & ~F.col("value").isin("", "\r")
    placed = placed.filter(F.col("inside") | first).withColumn("first", first.cast("int"))
    placed = materialize(placed.withColumn("n", F.sum("first").over(here.rowsBetween(Window.unboundedPreceding, 0))))
    starts = _before(materialize(placed.groupBy("file", "block").agg(F.sum("first").alias("n"))), "n")
    numbered = placed.join(starts, ["file", "block"]).withColumn("_row_number", F.col("start") + F.col("n") - 1)
    whole = (F.col("first") == 1) & (F.col("odd") == 0)
    alone = numbered.filter(whole).select("file", "_row_number", F.col("value").alias("record"))
    several = numbered.filter(~whole).groupBy("file", "_row_number").agg(F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("ls"))
    several = several.select("file", "_row_number", F.array_join(F.transform("ls", lambda x: x["value"]), "\n").alias("record"))
    endings = sums.groupBy("file").agg(F.min_by("ends", "block").alias("ends"))
    record = F.when(F.col("ends"), F.replace("record", F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("record"))
    several = several.join(endings, "file").select("file", "_row_number", record.alias("record"))
    records = alone.unionByName(several).withColumn("record", F.regexp_replace("record", r"\r\z", ""))
    records = materialize(records.withColumn("fine", well_quoted(F.col("record"), sep)))
    bad = [r["file"] for r in records.filter("not fine").select("file").distinct().collect()]  # of the given files
    return records.drop("fine"), sorted({*open_, *bad})


def csv_records(spark: SparkSession, path: str, sep: str) -> DataFrame | None:
    """_row_number and record of one file; None if its quotes need a reader from its beginning."""
    records, odd = records_of(spark, [path], sep)
    return None if odd else records.drop("file")


def cells_of(records: DataFrame, sep: str, options: dict[str, str]) -> DataFrame:
    """file, _row_number, columns, cells (as many as columns) of well-quoted records; each file has its own header. Columns without
    a name, or with another's, are named as Spark names them."""
    heads = records.filter("_row_number = 0")
    most = heads.agg(F.max(n_cells(F.col("record"), sep))).first()[0] or 1
    names = [f"c{i}" for i in range(most)]
    ddl = ", ".join(f"{n} string" for n in names)
    parse = lambda df: df.withColumn("_r", F.from_csv("record", ddl, {**options, "maxColumns": str(max(most + 1, 20480))})).withColumn("_cells", F.array(*(f"_r.{n}" for n in names)))
    low = F.transform("_own", F.lower)
    same = lambda h: F.size(F.filter(low, lambda x: x == F.lower(h))) > 1
    name = lambda h, i: F.when(F.coalesce(h, F.lit("")) == "", F.concat(F.lit("_c"), i)).when(same(h), F.concat(h, i)).otherwise(h)
    own = parse(heads.withColumn("_n", n_cells(F.col("record"), sep))).withColumn("_own", F.slice("_cells", F.lit(1), F.col("_n")))
    own = materialize(own.select("file", F.transform("_own", name).alias("columns")))  # a row a file
    return parse(records.filter("_row_number > 0")).join(own, "file").select("file", "_row_number", "columns", F.slice("_cells", F.lit(1), F.size("columns")).alias("cells"))
