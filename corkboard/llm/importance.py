"""Importance resampling towards a target: hashed n-gram counts by DuckDB in each partition, merged and scored by Spark.

DuckDB unnests a block's words, puts n-grams together by window functions, and counts them in buckets that a registered function
(CRC-32 by zlib) tells. A document's bucket counts are written to Parquet, which Spark reads twice: to sum what the corpus has in
each bucket, and to weigh documents. A document's weight is the mean of its features' log ratios of the target's share of a bucket
to the corpus's, to which Gumbel noise from its id is added; so the highest scores are a sample without replacement.
"""

from __future__ import annotations

import shutil
import tempfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corkboard.llm.common import row_blocks, small, stored, utf8

BUCKETS = 10_000
#: Bytes of text that DuckDB takes at once, and that one list of words comes from at most (a longer run without an end aside).
BLOCK_BYTES, SEGMENT_BYTES = 4 << 20, 1 << 20
#: What a worker's DuckDB may hold before it spills to its task's own folder, which goes with the task.
DUCKDB_MEMORY = "400MB"
#: A word is a run of characters that aren't these, A-Z lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = np.ones(256, bool)
_WORD[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False


def _crc(column: pa.Array) -> pa.Array:
    return pa.array([zlib.crc32(x) for x in column.cast(pa.large_binary()).to_pylist()], pa.uint32())


def _sql(longest: int, buckets: int) -> str:
    """Bucket counts of the table `segments` (row, segment, text), a row of the result for each row that has a feature."""
    grams = ["SELECT row, word AS feature FROM words"]
    for n in range(2, longest + 1):
        ahead = " || ' ' || ".join(["word", *[f"lead(word, {k}) OVER following" for k in range(1, n)]])
        grams.append(f"SELECT row, {ahead} FROM words WINDOW following AS (PARTITION BY row ORDER BY segment, place)")
    return f"""
WITH lists AS (SELECT row, segment, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS list FROM segments),
words AS (SELECT row, segment, unnest(list) AS word, unnest(range(len(list))) AS place FROM lists),
grams AS ({" UNION ALL ".join(grams)}),
counts AS (SELECT row, feature, count(*) AS n FROM grams WHERE feature IS NOT NULL GROUP BY ALL),
hashed AS (SELECT feature, crc32_of(feature) % {buckets} AS bucket FROM (SELECT DISTINCT feature FROM counts)),
dealt AS (SELECT row, bucket, CAST(sum(n) AS BIGINT) AS n FROM counts JOIN hashed USING (feature) GROUP BY ALL),
sizes AS (SELECT row, count(*) AS n_words FROM words GROUP BY ALL)
SELECT row, any_value(n_words) AS n_words, CAST(sum(n) AS BIGINT) AS n_features, list(bucket ORDER BY bucket) AS buckets, list(n ORDER BY bucket) AS counts FROM dealt JOIN sizes USING (row) GROUP BY row ORDER BY row"""


def _segments(data: np.ndarray, offsets: np.ndarray) -> pa.Table:
    """(row, segment, text) of rows of UTF-8 bytes: a text longer than SEGMENT_BYTES is cut where no word is."""
    rows, numbers, bounds = [], [], [0]
    for i in range(len(offsets) - 1):
        at, end, k = int(offsets[i]), int(offsets[i + 1]), 0
        while at < end:
            stop = at + SEGMENT_BYTES
            while stop < end:
                free = np.flatnonzero(~_WORD[data[stop : stop + SEGMENT_BYTES]])
                stop += int(free[0]) if len(free) else SEGMENT_BYTES
                if len(free):
                    break
            at = min(stop, end)
            rows.append(i)
            numbers.append(k)
            bounds.append(at)
            k += 1
    raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(np.array(bounds, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    return pa.table({"row": pa.array(rows, pa.int64()), "segment": pa.array(numbers, pa.int64()), "text": raw.cast(pa.large_string())})


def bucket_counts(docs: DataFrame, id_column: str = "doc_id", longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(id, n_words, n_features, buckets: array, counts: array) of each row of docs, by ascending bucket, written to Parquet in
    the shared folder. Features are all runs of 1 to `longest` consecutive words, joined by one space, repeats counted; a text
    without words, or null, has none. Bytes that aren't UTF-8 fail."""
    sql = _sql(longest, buckets)

    def count(batches):
        import duckdb

        folder = tempfile.mkdtemp()
        db = duckdb.connect(config={"threads": 1, "memory_limit": DUCKDB_MEMORY, "temp_directory": folder})
        try:
            db.create_function("crc32_of", _crc, ["VARCHAR"], "UINTEGER", type="arrow")
            for batch in batches:
                data, offsets = utf8(batch.column("text"))
                for first, end in row_blocks(offsets, BLOCK_BYTES):
                    n = end - first
                    db.register("segments", _segments(data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]))
                    found = db.sql(sql).to_arrow_table().combine_chunks()
                    db.unregister("segments")
                    which = pa.array(np.searchsorted(found["row"].to_numpy(), np.arange(n)))  # null where a row has no words
                    there = pa.array(np.isin(np.arange(n), found["row"].to_numpy()))
                    which = pa.compute.if_else(there, which, None)
                    sizes = [pa.compute.fill_null(found[c].cast(pa.int64()).take(which).combine_chunks(), 0) for c in ("n_words", "n_features")]
                    lists = [pa.compute.fill_null(found[c].cast(pa.list_(pa.int64())).combine_chunks().take(which), pa.scalar([], pa.list_(pa.int64()))) for c in ("buckets", "counts")]
                    yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, n), *sizes, lists[0].cast(pa.list_(pa.int32())), lists[1]], names=["id", "n_words", "n_features", "buckets", "counts"])
        finally:
            db.close()
            shutil.rmtree(folder, ignore_errors=True)

    kind = docs.schema[id_column].dataType.simpleString()
    slim = docs.select(F.col(id_column).alias("id"), "text")
    return stored(slim.mapInArrow(count, f"id {kind}, n_words long, n_features long, buckets array<int>, counts array<long>"), "bucket-counts")


def merged(counts: DataFrame) -> DataFrame:
    """(bucket, n) over all rows of bucket_counts: as many rows as buckets at most."""
    return counts.select(F.explode(F.arrays_zip("buckets", "counts")).alias("x")).groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum("x.counts").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """For each bucket, a thousand log ratios of the target's share to the corpus's, one added to each count, floored. From as many
    rows as buckets of either, which come to the driver."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for held, counts in ((s, corpus), (t, target)):
        for r in merged(counts).toLocalIterator():
            held[r["bucket"]] = r["n"]
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weights(counts: DataFrame, gain: np.ndarray) -> DataFrame:
    """(id, n_words, n_features, weight) of bucket_counts: the floored mean of the features' gains, 0 without features."""
    shared = counts.sparkSession.sparkContext.broadcast(gain)  # a number a bucket

    def weigh(batches):
        table = shared.value
        for batch in batches:
            n, sizes = batch.num_rows, batch.column("n_features").to_numpy()
            lists = batch.column("buckets")
            bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            run = np.concatenate([[0], np.cumsum(table[lists.flatten().to_numpy()] * batch.column("counts").flatten().to_numpy())])
            total = run[bounds[1:]] - run[bounds[:-1]]
            weight = np.where(sizes > 0, total // np.maximum(sizes, 1), 0) if n else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_words"), batch.column("n_features"), pa.array(weight, pa.int64())], names=["id", "n_words", "n_features", "weight"])

    return counts.mapInArrow(weigh, f"id {counts.schema['id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def noise(id_column: Column, seed: int) -> Column:
    """A thousand times a Gumbel draw, floored, from the first 8 hex digits of sha256(`<seed>:<id>`); a null id is empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def ranked(scored: DataFrame, eligible: Column, percent: int) -> DataFrame:
    """scored (doc_id, score: whole numbers) with rank: 1, 2, 3 ... of the floor(percent * N / 100) highest scores of the N eligible
    rows, ties to the smaller doc_id, null first; null for others.

    Places are told by how many rows each score has, in two levels, so that no task holds more than 1024 scores' counts or one
    score's rows; noise spreads the scores, of which the most frequent one has about a row in 2700."""
    block = F.shiftright(F.col("score"), 10)
    by_score = stored(scored.filter(eligible).groupBy("score").agg(F.count("*").alias("n")), "scores")
    blocks = by_score.groupBy(block.alias("block")).agg(F.sum("n").alias("n"))
    before = {r["block"]: r["n"] for r in blocks.collect()}  # a number for a thousand scores
    run, above = 0, []
    for b in sorted(before, reverse=True):
        above.append((b, run))
        run += before[b]
    draw = percent * run // 100
    starts = by_score.sparkSession.createDataFrame(above, "block long, above long")
    inner = Window.partitionBy("block").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    placed = by_score.withColumn("block", block.cast("long")).join(F.broadcast(starts), "block").select(F.col("score"), (F.col("above") + F.coalesce(F.sum("n").over(inner), F.lit(0))).alias("above"))
    met = scored.withColumn("_drawn", F.coalesce(eligible, F.lit(False))).join(small(stored(placed.filter(F.col("above") < draw), "drawn-scores")), "score", "left")
    inside = F.col("_drawn") & F.col("above").isNotNull()
    first = met.filter(inside).withColumn("rank", F.col("above") + F.row_number().over(Window.partitionBy("score").orderBy("doc_id")))
    told = first.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank"))).unionByName(met.filter(~inside).withColumn("rank", F.lit(None).cast("long")))
    return told.drop("above", "_drawn")


def resampled(docs: DataFrame, target: DataFrame, target_id: str = "item_id", longest: int = 1, buckets: int = BUCKETS, least_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row of docs: the importance of its text for the distribution of target's
    texts. Documents of fewer than least_words words aren't drawn. Null texts have no features, null ids draw as the empty id, and
    rows that share an id draw the same noise. Without target texts, weights are what the corpus alone gives; an empty table gives
    none."""
    counts = bucket_counts(docs, "doc_id", longest, buckets)
    gain = gains(counts, bucket_counts(target, target_id, longest, buckets), buckets)
    scored = weights(counts, gain).withColumn("score", F.col("weight") + noise(F.col("id"), seed)).withColumnRenamed("id", "doc_id")
    return ranked(stored(scored, "scored"), F.col("n_words") >= least_words, percent).select("doc_id", "n_features", "weight", "score", "rank")
