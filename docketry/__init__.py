"""Document and case analytics on Spark DataFrames."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


#: Rows of one batch between the JVM and a Python worker, and of one batch of a Parquet scan.
ARROW_ROWS, SCAN_ROWS = "128", "512"


def ship(spark: SparkSession) -> None:
    """Makes this package importable on the executors, once for each context.

    Texts can be long, so Arrow batches are cut to ARROW_ROWS rows and those of
    scans to SCAN_ROWS where the session has Spark's default, and the shuffle files of a query are dropped when
    it ends, as results that are used again are tables in the shared folder.
    """
    context = spark.sparkContext
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    if spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "4096":
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", SCAN_ROWS)
    if getattr(context, "_docketry_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="docketry-"), "docketry.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(home):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(home)))
    context.addPyFile(path)
    context._docketry_shipped = True
