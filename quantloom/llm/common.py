"""What the corpus operators share: the shared folder, materialised tables and Python batches of bounded size."""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handed to Python at once; texts run to megabytes, so the default of 10,000 rows has no useful bound.
BATCH_ROWS = 256

_scratch: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir`` of the session.

    Only where a session on one machine has none (tests) a folder of our own is set; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file:///tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/quantloom-{spark.sparkContext.applicationId}")
    # with its scheme, so that Python on the executors writes where Spark does
    root = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if root not in _scratch:
        _scratch[root] = spark
    return root


@atexit.register
def _remove_scratch() -> None:
    """Best effort: the tables outlive lazily evaluated results, so they go when the application ends."""
    for root, spark in _scratch.items():
        try:
            jvm = spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001  the session may have ended first
            pass


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts lineage like ``checkpoint()`` but stays columnar, so later passes read only the columns they use,
    and everything downstream sees the same rows in the same files after an executor is lost.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the Arrow batch size where it is above ``rows`` (Spark bounds batches by rows, not bytes)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


def filesystem(uri: str):
    """``(pyarrow filesystem, path)`` for a folder URI or a plain absolute path."""
    from pyarrow import fs

    local = uri.removeprefix("file:")
    return (fs.LocalFileSystem(), f"/{local.lstrip('/')}") if local.startswith("/") else fs.FileSystem.from_uri(uri)


def as_name(df: DataFrame, column: str):
    """An id as string, in which it goes through Python: pandas would turn large numbers beside nulls into floats."""
    return F.col(f"`{column}`").cast("string")


def rows_of(spark: SparkSession, json_rows: str, schema: str) -> DataFrame:
    """A small literal table through SQL alone."""
    return spark.sql("SELECT inline(from_json(:rows, :kind))", args={"rows": json_rows, "kind": f"array<struct<{schema}>>"})
