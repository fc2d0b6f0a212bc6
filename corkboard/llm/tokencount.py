"""Token counts: pieces counted once per distinct pre-token, joined to each document's pre-token frequencies, summed.

Most occurrences are of few pre-tokens. The most frequent ones (HEAD_PIECES at most, of HEAD_BYTES at most each) go to all
workers as a table; a document's other pre-tokens meet the rest of the vocabulary in a join. No ids are made for a text.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corkboard.llm.common import stored
from corkboard.llm.pretokens import hub_tokenizer

HEAD_PIECES = 300_000
HEAD_BYTES = 64
#: A worker hands on what it has counted when it holds this many distinct pre-tokens.
FLUSH = 300_000


def vocabulary(docs: DataFrame, file: str) -> DataFrame:
    """(piece, key, n, pieces) of each distinct pre-token of docs: a 64-bit key, occurrences, and tokens it makes."""

    def counted(batches):
        tokenizer, seen = hub_tokenizer(file), Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["piece", "n"])

        for batch in batches:
            for text in batch.column("text"):
                seen.update(tokenizer.pieces(text.as_py() or ""))
                if len(seen) >= FLUSH:
                    yield rows()
                    seen.clear()
        if seen:
            yield rows()

    def sized(batches):
        tokenizer = hub_tokenizer(file)
        for batch in batches:
            pieces = batch.column("piece").to_pylist()
            sizes = list(map(len, tokenizer.piece_ids(pieces)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int32())], names=["piece", "n", "pieces"])

    distinct = docs.select("text").mapInArrow(counted, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return stored(distinct.mapInArrow(sized, "piece string, n long, pieces int").withColumn("key", F.xxhash64("piece")), "vocabulary")


def _head(words: DataFrame, most: int) -> DataFrame:
    """The rows of words above a frequency that `most` of them at most reach, of short pieces only; and all of a key that
    is not one piece's alone, so that the keys of the rest are exact."""
    short = F.octet_length("piece") <= HEAD_BYTES
    levels = words.filter(short).agg(*[F.count_if(F.col("n") >= 2**k).alias(str(k)) for k in range(48)]).first()
    level = next(k for k in range(48) if levels[str(k)] <= most or k == 47)
    shared = words.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    return words.filter(short & (F.col("n") >= 2**level)).unionByName(words.join(shared, "key", "left_semi")).distinct()


def count(docs: DataFrame, file: str, head_pieces: int = HEAD_PIECES) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for each row of docs, in no order; null text counts as empty, with 0 tokens. Rows of
    one doc_id stay apart."""
    rows = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    words = vocabulary(docs, file)
    head = {r["piece"]: r["pieces"] for r in _head(words, head_pieces).select("piece", "pieces").toLocalIterator()}
    shared = docs.sparkSession.sparkContext.broadcast(head)

    def summed(batches):
        tokenizer, known = hub_tokenizer(file), shared.value
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                sizes, totals, rest, times, bounds = [], [], [], [], [0]
                for text in part.column("text"):
                    text = text.as_py() or ""
                    sizes.append(len(text.encode()))
                    total = 0
                    for piece, n in Counter(tokenizer.pieces(text)).items():
                        c = known.get(piece)
                        if c is None:
                            rest.append(piece)
                            times.append(n)
                        else:
                            total += c * n
                    totals.append(total)
                    bounds.append(len(rest))
                tail = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), x) for x in (pa.array(rest, pa.string()), pa.array(times, pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()), *tail], names=["row", "doc_id", "n_bytes", "sure", "rest", "times"])

    found = rows.mapInArrow(summed, f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, sure long, rest array<string>, times array<int>")
    found = stored(found.withColumn("rest", F.transform("rest", lambda p: F.xxhash64(p))), "token-counts")
    tail = found.select("row", F.explode(F.arrays_zip("rest", "times")).alias("t")).select("row", F.col("t.rest").alias("key"), F.col("t.times").alias("times"))
    more = tail.join(words.select("key", "pieces"), "key").groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    return found.drop("rest", "times").join(more, "row", "left").select("doc_id", "n_bytes", (F.col("sure") + F.coalesce("more", F.lit(0))).alias("n_tokens"))
