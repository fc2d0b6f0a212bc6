"""What the operators share: the cluster's shared folder, Arrow text access, doc_id remainders."""

from __future__ import annotations

import contextlib
import functools
import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when it has at most this many (narrow) rows; beyond it, the join shuffles.
BROADCAST_ROWS = 500_000


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one in the warehouse, which they share too."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/corkboard-scratch"
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, removed when the application ends."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


_scratch: list[dict[int, tuple[DataFrame, str]]] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: cuts lineage, survives lost executors, computed once."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    if _scratch:
        _scratch[-1][id(found)] = (found, path)
    return found


@contextlib.contextmanager
def scratch():
    """What is stored within is deleted at the end, but for the tables that the yielded function is called with, which it
    returns. So nothing that is read later may depend on another one."""
    _scratch.append({})
    kept: set[int] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(id(df))
        return df

    try:
        yield keep
    finally:
        held = _scratch.pop()
        for key, (df, path) in held.items():
            if key not in kept:
                hadoop_path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                hadoop_path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)
            elif _scratch:
                _scratch[-1][key] = (df, path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count shows at most `rows` rows, else df for a shuffle join. df should be stored."""
    return F.broadcast(df) if df.count() <= rows else df


def id_remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids count as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.encode(F.coalesce(c.cast("string"), F.lit("")), "UTF-8")) % modulus


def bounded_sample(df: DataFrame, key: Column, most: int, seed: int) -> DataFrame:
    """About `most` rows of df at most, by a hash of key: the same rows however df is partitioned."""
    n = df.count()
    if n <= most:
        return df
    draw = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000_007)) / F.lit(1_000_000_007.0)
    return df.filter(draw < F.lit(most / n))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's bounds in them (n + 1); null is empty."""
    a = (column.fill_null("") if column.null_count else column).cast(pa.large_binary())
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_blocks(offsets: np.ndarray, most_bytes: int = 1 << 20):
    """Runs (first, end) of rows with at most most_bytes each, or a single longer row."""
    first, n = 0, len(offsets) - 1
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + most_bytes, "right")) - 1
        end = min(max(end, first + 1), n)
        yield first, end
        first = end


def trim() -> None:
    """Gives memory that a worker no longer holds back to the system, where the C library can: workers outlive their tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


@contextlib.contextmanager
def uncollected():
    """Within, Python doesn't look for cycles: for loops that make many lists and no cycles."""
    before = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if before:
            gc.enable()


def trimmed(task):
    """A function of batches, after which its worker gives back what it no longer holds."""

    @functools.wraps(task)
    def run(batches):
        try:
            yield from task(batches)
        finally:
            trim()

    return run


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Plans that run within give Python tasks Arrow batches of at most `rows` rows, which executors and workers both hold whole."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def ship(spark: SparkSession) -> None:
    """Lets Python workers that share this file system import the package; elsewhere it comes by --py-files."""
    import os

    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if top not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (top, known) if x)
