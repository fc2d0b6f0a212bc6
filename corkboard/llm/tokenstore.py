"""Token ids in ORC files: run-length encoded integers, row indexes, Bloom filters on document ids.

A file holds a contiguous range of ascending doc_id, so that readers prune files and stripes by the statistics and Bloom
filters of doc_id, and read stripes in parallel. `part` and `before` (ids of earlier documents in the part) give every
document's place in the whole token stream once the parts' totals are known.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corkboard.llm.common import small, stored, uncollected
from corkboard.llm.pretokens import hub_tokenizer

END = 0
STRIPE_BYTES = 16 << 20
ROWS_AN_INDEX = 1_000


def encode(docs: DataFrame, file: str, end: int = END) -> DataFrame:
    """(doc_id, part, before, ids) in ascending doc_id, null first, rows of one doc_id by text. Null text counts as empty:
    its only id is `end`. An empty table gives none."""
    sorted_docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    last = np.array([end], "<u4").tobytes()

    def encoded(batches):
        tokenizer, before, part = hub_tokenizer(file), 0, TaskContext.get().partitionId()
        for batch in batches:
            for first in range(0, batch.num_rows, 100):
                rows = batch.slice(first, 100)
                with uncollected():
                    found = [x + last for x in tokenizer.encode(rows.column("text").to_pylist())]
                sizes = np.array([len(x) // 4 for x in found], np.int64)
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                ids = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<u4").astype(np.int32)))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.full(len(sizes), part, np.int32)), pa.array(before + bounds[:-1]), ids], names=["doc_id", "part", "before", "ids"])
                before += int(bounds[-1])

    return sorted_docs.mapInArrow(encoded, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, part int, before long, ids array<int>")


def write(docs: DataFrame, file: str, path: str, end: int = END) -> None:
    """Encode docs and write them at path."""
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": str(ROWS_AN_INDEX), "orc.stripe.size": str(STRIPE_BYTES), "orc.compress": "ZSTD"}
    encode(docs, file, end).write.options(**options).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows; a filter on doc_id reaches the files' statistics and Bloom filters."""
    return spark.read.orc(path)


def _digests(batches):
    for batch in batches:
        ids = batch.column("ids")
        values = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        offsets = ids.offsets.to_numpy()
        crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("before"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "part", "before", "n_tokens", "ids_crc32"])


def summary(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each row of the files at path, from the ids read back. start: ids of all
    documents before it."""
    files = read(spark, path)
    rows = stored(files.mapInArrow(_digests, f"doc_id {files.schema['doc_id'].dataType.simpleString()}, part int, before long, n_tokens long, ids_crc32 long"), "token-digests")
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))  # as many rows as files
    base = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    return rows.join(small(stored(base, "token-parts")), "part").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
