"""What the operators share: durable tables, shipping, record batches, joins on skewed keys."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import BATCH_ROWS, bounded_batches, ship  # noqa: F401
from ..tables import mark, materialize, new_folder, read_table, release, shared_dir  # noqa: F401

def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, so that a batch of very long texts isn't held decoded as a whole. At the end of the
    input the memory that the task has freed goes back to the system: workers live on, beside each other."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
    give_back()


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library; elsewhere there is nothing to do
    if trim:
        trim(0)


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as bytes; null is empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{table}.parquet")


def renamed(df: DataFrame) -> tuple[DataFrame, dict[str, str], Callable[[DataFrame], DataFrame]]:
    """``df`` under names that no operator's own columns have, the new name of each column, and a function that
    selects the columns again under their names: for functions that keep all columns of a row."""
    names = {c: f"_in{i}_" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names, lambda out: out.select(*(F.col(n).alias(c) for c, n in names.items()))


def skew_join(left: DataFrame, right: DataFrame, key: str, heavy: DataFrame) -> DataFrame:
    """Left join on a key that is unique on the right, whatever share of the left one key has.

    heavy: the keys (column ``key``) that hold over 1/HEAVY of the left rows. There are at most
    HEAVY of them, so their rows of the right side are broadcast; other keys are shuffled.
    """
    heavy = F.broadcast(heavy.select(F.col(key).alias("_heavy")))
    split = left.join(heavy, F.col(key) == F.col("_heavy"), "left")
    few = right.join(heavy, F.col(key) == F.col("_heavy"), "left_semi")
    hot = split.filter(F.col("_heavy").isNotNull()).drop("_heavy").join(F.broadcast(few), key, "left")
    rest = split.filter(F.col("_heavy").isNull()).drop("_heavy").join(right.hint("merge"), key, "left")
    return rest.unionByName(hot)


#: At most so many keys hold more than 1 / HEAVY of the rows each.
HEAVY = 1000


def heavy_keys(counts: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Of a table with a row per key and its rows n, the keys with over total / HEAVY rows; under HEAVY of them."""
    return counts.filter(F.col(n) > max(1, total // HEAVY)).select(key)


def ascii_lower(text: Column) -> Column:
    """A-Z only. lower() does the same, and faster, where all characters are ASCII."""
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, up, low))


_TOKEN = re.compile(rb"[^ ]+")


def windows(text: bytes, size: int, carry: int) -> Iterator[tuple[bytes, int]]:
    """Parts of a text whose tokens stand between spaces, cut between tokens after ``size`` bytes or a little more.

    A part goes on with up to ``carry`` tokens of the next, so that runs of tokens that start in it are whole; it owns the
    places before them. Their number comes with it. Only one part is copied at a time.
    """
    at = 0
    while at < len(text):
        end = text.find(b" ", at + size)
        if end < 0:
            yield text[at:], 0
            return
        stop, more = end, 0
        while more < carry and (found := _TOKEN.search(text, stop)):
            stop, more = found.end(), more + 1
        yield text[at:stop], more
        at = end


@contextmanager
def batches_of(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """At most so many rows a record batch for what is written meanwhile; then the session's setting holds again."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= rows:
        spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows``, written once, with _rank from 1 in the given order, which must tell rows apart. Rows are dealt by ranges
    of the order; a row's rank is its place in its range after the counts of the ranges before."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    fixed = materialize(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    parts = fixed.groupBy("_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # A row a range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = materialize(parts.select(F.col("_part").alias("_p"), "_first", before.alias("_before")))
    placed = fixed.join(F.broadcast(starts), F.col("_part") == F.col("_p"))
    return placed.withColumn("_rank", F.col("_at") - F.col("_first") + F.col("_before") + 1).drop("_part", "_at", "_p", "_first", "_before")
