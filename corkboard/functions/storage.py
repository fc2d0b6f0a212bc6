"""Tables that a plan writes and reads again: lineage is cut, and what several consumers need is computed once."""

from __future__ import annotations

import gc
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that a broadcast side may take, by its rows' number and their widths as the caller states them.
BROADCAST_BYTES = 128 << 20


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir (or, where that is unset, the warehouse), removed when the application ends. A folder
    of this machine alone is refused where executors are on others."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/corkboard-scratch"
    if root == spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.master.startswith("local") or not root.startswith(("file:", "/")):
        path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
        return path
    raise ValueError(f"set spark.checkpoint.dir: executors don't share {root}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to a shared path and read back."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Removes the files of stored tables that nothing reads any more. Spark removes the shuffles of jobs that are over when the JVM
    collects their plans, which a driver of much memory seldom does, so it is asked to."""
    for path in {os.path.dirname(f) for df in tables for f in df.inputFiles()}:
        hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """A stored df with a broadcast hint if its rows of row_bytes each are few enough, else df for a shuffle join."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def ship(spark: SparkSession) -> None:
    """Lets Python workers that share this file system import the package; elsewhere it comes by --py-files."""
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if top not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (top, known) if x)
