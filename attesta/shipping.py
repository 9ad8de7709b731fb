"""Gives Python workers this package: a zip of its sources goes to the executors once per Spark application."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent
_sent: set[str] = set()


def ship(spark: SparkSession | None = None) -> None:
    spark = spark or SparkSession.getActiveSession()
    if spark is None or spark.sparkContext.applicationId in _sent:
        return
    # Spark's file server hands the file out as long as the application runs
    folder = tempfile.mkdtemp(prefix="attesta-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = Path(folder) / f"{_PACKAGE.name}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(_PACKAGE.rglob("*")):
            if f.suffix in (".py", ".txt"):
                z.write(f, str(f.relative_to(_PACKAGE.parent)))
    spark.sparkContext.addPyFile(str(path))
    _sent.add(spark.sparkContext.applicationId)


#: Rows that Spark hands to a worker at once. Its own setting is 10,000, of whole texts tens of megabytes, held on both sides.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession | None = None, rows: int = BATCH_ROWS) -> None:
    """Lower the session's rows of a batch, for operators that send whole texts to workers."""
    spark = spark or SparkSession.getActiveSession()
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark is not None and not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)
