"""Change data from a stream of observed files, against a stored snapshot or against a state of one value a path."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SNAPSHOT = "path string, content_hash string"


def step(batch: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changes, snapshot after) of a batch (path, content_hash, seq): of each path the row of the largest seq counts, of equal
    seq the largest hash; a null hash means that the file has gone. Rows that change nothing are in no change."""
    last = batch.filter("path IS NOT NULL").groupBy("path").agg(F.max(F.struct("seq", "content_hash")).alias("m")).select("path", F.col("m.content_hash").alias("new_hash"), F.lit(True).alias("seen"))
    met = before.withColumnRenamed("content_hash", "old_hash").join(last, "path", "full_outer")
    kind = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").otherwise("modified")
    changed = met.filter(F.col("seen") & ~F.col("old_hash").eqNullSafe(F.col("new_hash"))).select("path", kind.alias("change"), "old_hash", "new_hash")
    after = met.select("path", F.when(F.col("seen"), F.col("new_hash")).otherwise(F.col("old_hash")).alias("content_hash")).filter("content_hash IS NOT NULL")
    return changed, after


def follow(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Starts a query over what the stream holds now (path, content_hash, seq). Each batch writes its changes to
    table/changes/batch=N and the snapshot after it to table/snapshot-N. A batch that is run again after a failure reads the
    same snapshot as before and replaces what it had written. Older snapshots are left for the caller's retention."""

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(SNAPSHOT).parquet(f"{table}/snapshot-{n - 1}") if n else spark.createDataFrame([], SNAPSHOT)
        changed, after = step(batch, before)
        after.write.mode("overwrite").parquet(f"{table}/snapshot-{n}")
        changed.write.mode("overwrite").parquet(f"{table}/changes/batch={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changes(spark: SparkSession, table: str) -> DataFrame:
    """(path, change, old_hash, new_hash, batch) of all batches."""
    return spark.read.parquet(f"{table}/changes")


CHANGES = "path string, change string, old_hash string, new_hash string"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Paths(StatefulProcessor):
    """Keeps the content hash of a path that is there. The last row of a batch counts, by seq and then by hash."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "content_hash string")

    def handleInputRows(self, key, rows, timer_values):
        last = None
        for part in rows:
            for seq, digest in zip(part["seq"], part["content_hash"]):
                found = (seq, digest is not None and digest == digest, digest if digest == digest else None)
                if last is None or found[:2] > last[:2] or (found[:2] == last[:2] and found[1] and found[2] > last[2]):
                    last = found
        if last is None:
            return
        old = self.held.get()[0] if self.held.exists() else None
        new = last[2]
        if old == new:
            return
        if new is None:
            self.held.clear()
        else:
            self.held.update((new,))
        change = "added" if old is None else "removed" if new is None else "modified"
        yield pd.DataFrame({"path": [key[0]], "change": [change], "old_hash": [old], "new_hash": [new]})

    def close(self) -> None:
        pass


def changes_by_state(stream: DataFrame) -> DataFrame:
    """The changes (path, change, old_hash, new_hash) that a stream (path, content_hash, seq) tells, by the rules of `step`. A path's
    hash is a value in the state store, so a batch costs its own rows, however many paths are known. Needs STATE_STORE as
    spark.sql.streaming.stateStore.providerClass. Rows without a path are left out."""
    rows = stream.filter("path IS NOT NULL").select("path", "content_hash", "seq")
    return rows.groupBy("path").transformWithStateInPandas(statefulProcessor=_Paths(), outputStructType=CHANGES, outputMode="Append", timeMode="None")


def follow_by_state(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """As `follow`, but what is known lies in the state store beside the checkpoint; no snapshot is written. A batch that is run again
    after a failure starts from the state before it and replaces the changes that it had written."""

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/changes/batch={n}")

    return changes_by_state(stream).writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
