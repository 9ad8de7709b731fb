"""Durable intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_staged: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a temporary one becomes it if all of Spark
    runs in one process; on a cluster, whose executors couldn't see it, that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
        found = tempfile.mkdtemp(prefix="attesta-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession) -> str:
    """A path in the shared folder, for files that release() deletes."""
    path = f"{shared_dir(spark)}/attesta-{uuid.uuid4().hex}"
    _staged.append(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors,
    and fixes the rows of expressions that depend on the task, such as row numbers."""
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within it, what a job shuffles is deleted as soon as the job has ended, not when its frame is collected. For jobs that write
    their result and aren't repeated."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


#: Tables up to this size are dealt over all cores when they are read.
SPREAD_BYTES = 1 << 30


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table. One of few files can hold fewer row groups than there are cores, which leaves cores idle; if
    it is small, its rows are dealt over all of them, and larger tables are read as they are split."""
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= SPREAD_BYTES and len(df.inputFiles()) < cores else df


def mark() -> int:
    """How many tables are staged now, for release()."""
    return len(_staged)


def release(spark: SparkSession, since: int = 0) -> None:
    """Delete the tables that materialize() wrote after mark() gave ``since``; frames that read them can't be used afterwards."""
    jvm = spark.sparkContext._jvm
    while len(_staged) > since:
        path = jvm.org.apache.hadoop.fs.Path(_staged.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
