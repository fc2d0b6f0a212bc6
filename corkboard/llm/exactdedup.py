"""Exact deduplication: batches screened by static binary-fuse filters of an immutable snapshot.

A snapshot is a written table of groups of equal texts, with one filter for each bucket of digests. A new batch is grouped
by digest first; its digests then meet the filters of their buckets. Those that a filter knows join the snapshot's exact
groups on all 256 bits and the length, and the bytes of what joins are compared; the rest are new for certain.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corkboard.llm.common import small, stored
from corkboard.llm.kernels import mix

#: Distinct digests in a bucket, about; a filter takes nine bits or so of each.
BUCKET_KEYS = 100_000
#: What is deleted before texts are compared.
SPACES = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def _digest(normal: Column) -> Column:
    return F.sha2(F.encode(normal, "UTF-8"), 256)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, sha (hex), size (bytes of the normalised text), n_chars) of each row; null text counts as empty."""
    n = normalised(F.col("text"))
    return docs.select("doc_id", _digest(n).alias("sha"), F.octet_length(n).alias("size"), F.length(F.coalesce("text", F.lit(""))).alias("n_chars"))


def grouped(rows: DataFrame) -> DataFrame:
    """A row for each digest: the row that stays (most code points, then smallest doc_id, a null id last) and the number of
    rows. Counts are made before rows are shuffled, so a group of any number of copies costs one row a task."""
    first = F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"))
    return rows.groupBy("sha", "size").agg(F.min(first).alias("best"), F.count("*").alias("rows"))


def _merged(groups: DataFrame) -> DataFrame:
    return groups.groupBy("sha", "size").agg(F.min("best").alias("best"), F.sum("rows").alias("rows"))


# ---- binary fuse filters -------------------------------------------------------------------------------------------


def _places(keys: np.ndarray, seed: int, segments: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Three places of each key, one in each of three neighbouring segments, and its 8-bit fingerprint."""
    h = mix(keys + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
    start = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    base = start * np.uint64(length)
    mask = np.uint64(length - 1)
    places = np.stack([base + (h & mask), base + np.uint64(length) + ((h >> np.uint64(18)) & mask), base + np.uint64(2 * length) + (mix(h) & mask)])
    return places.astype(np.int64), (mix(h + np.uint64(1)) & np.uint64(255)).astype(np.uint8)


@dataclass
class FuseFilter:
    """Of a fixed set of distinct 64-bit keys. Never denies one of them; takes one in 256 others for one of them."""

    seed: int
    segments: int
    length: int
    slots: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray) -> FuseFilter:
        keys = np.unique(np.asarray(keys, np.uint64))
        n = max(1, len(keys))
        length = 1 << max(2, min(18, int(np.floor(np.log(n) / np.log(3.33) + 2.25))))
        factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
        segments = max(1, int(np.ceil(n * factor / length)) - 2)
        for seed in range(200):
            slots = cls._peel(keys, seed, segments, length)
            if slots is not None:
                return cls(seed, segments, length, slots)
            if seed % 20 == 19:
                segments += 1 + segments // 20
        raise ValueError("no binary fuse filter was found for these keys")

    @staticmethod
    def _peel(keys: np.ndarray, seed: int, segments: int, length: int) -> np.ndarray | None:
        """Round after round, takes off all keys that are alone in a place; then sets these places in reverse order, so
        that the XOR of a key's three slots is its fingerprint."""
        places, prints = _places(keys, seed, segments, length)
        size = (segments + 2) * length
        count = np.bincount(places.ravel(), minlength=size)
        which = np.zeros(size, np.int64)  # XOR of the numbers of the keys in a place; of a lone key, its number
        for row in places:
            np.bitwise_xor.at(which, row, np.arange(len(keys)))
        order, left = [], len(keys)
        lone = np.flatnonzero(count == 1)
        while len(lone):
            own, at = np.unique(which[lone], return_index=True)
            order.append((own, lone[at]))
            left -= len(own)
            for row in places[:, own]:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(which, row, own)
            touched = np.unique(places[:, own])
            lone = touched[count[touched] == 1]
        if left:
            return None
        slots = np.zeros(size, np.uint8)
        for own, at in reversed(order):
            others = slots[places[0, own]] ^ slots[places[1, own]] ^ slots[places[2, own]] ^ slots[at]
            slots[at] = prints[own] ^ others
        return slots

    def might_hold(self, keys: np.ndarray) -> np.ndarray:
        places, prints = _places(np.asarray(keys, np.uint64), self.seed, self.segments, self.length)
        return (self.slots[places[0]] ^ self.slots[places[1]] ^ self.slots[places[2]]) == prints

    def to_bytes(self) -> bytes:
        return np.array([self.seed, self.segments, self.length], "<u4").tobytes() + self.slots.tobytes()

    @classmethod
    def from_bytes(cls, b: bytes) -> FuseFilter:
        seed, segments, length = (int(x) for x in np.frombuffer(b[:12], "<u4"))
        return cls(seed, segments, length, np.frombuffer(b[12:], np.uint8))


# ---- snapshots -----------------------------------------------------------------------------------------------------


@dataclass
class Snapshot:
    """groups: (sha, size, best, rows), written. filters: (bucket, filter), written; one for each of `buckets` buckets that has keys."""

    groups: DataFrame
    filters: DataFrame
    buckets: int


def _key(sha: Column) -> Column:
    """The first 64 bits of a digest, signed."""
    return F.conv(F.substring(sha, 1, 16), 16, -10).cast("long")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("sha"), F.lit(buckets))


def _built(group: pa.Table) -> pa.Table:
    return pa.table({"bucket": group["bucket"].slice(0, 1), "filter": pa.array([FuseFilter.of(group["key"].to_numpy().view(np.uint64)).to_bytes()], pa.binary())})


def snapshot(groups: DataFrame) -> Snapshot:
    """An immutable snapshot of groups, written to the shared folder with its filters."""
    groups = stored(groups, "dedup-groups")
    buckets = max(1, groups.count() // BUCKET_KEYS + 1)
    keys = groups.select(_bucket(buckets).alias("bucket"), _key(F.col("sha")).alias("key"))
    filters = stored(keys.groupBy("bucket").applyInArrow(_built, "bucket long, filter binary"), "dedup-filters")
    return Snapshot(groups, filters, buckets)


def _screened(new: pa.Table, known: pa.Table) -> pa.Table:
    if not len(new) or not len(known):
        return new.select(["sha"]).slice(0, 0)
    met = FuseFilter.from_bytes(known["filter"][0].as_py()).might_hold(new["key"].to_numpy().view(np.uint64))
    return new.select(["sha"]).filter(pa.array(met))


def screen(batch: DataFrame, old: Snapshot) -> tuple[DataFrame, DataFrame]:
    """Of groups of a new batch: (those whose digest the snapshot's filters know, the rest, which are new for certain)."""
    salts = batch.count() // (old.buckets * BUCKET_KEYS) + 1  # a bucket's filter goes to as many tasks as its share of the batch needs
    keyed = batch.select("sha", _bucket(old.buckets).alias("bucket"), _key(F.col("sha")).alias("key")).withColumn("salt", F.pmod("key", F.lit(salts)))
    filters = old.filters.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    found = keyed.groupBy("bucket", "salt").cogroup(filters.groupBy("bucket", "salt")).applyInArrow(_screened, "sha string")
    maybe = stored(found.distinct(), "dedup-positives")
    return batch.join(maybe, "sha", "left_semi"), batch.join(maybe, "sha", "left_anti")


def check_bytes(maybe: DataFrame, old: Snapshot, docs: DataFrame) -> None:
    """Compares the normalised bytes of each positive's row that stays with those of its exact group in the snapshot.
    Raises ValueError where texts of one digest and length differ: then digests can't tell these documents' groups."""
    ids = maybe.select("sha", "size", F.col("best.doc_id").alias("a")).join(old.groups.select("sha", "size", F.col("best.doc_id").alias("b")), ["sha", "size"])
    pairs = stored(ids.filter("a IS NOT NULL AND b IS NOT NULL").select("sha", "a", "b"), "dedup-pairs")
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "dedup-compared")
    n = normalised(F.col("text"))
    texts = docs.select("doc_id", "text").join(small(wanted), "doc_id", "left_semi").select("doc_id", n.alias("bytes"), _digest(n).alias("sha"))
    several = pairs.select("sha", F.explode(F.array("a", "b")).alias("doc_id")).join(texts, ["sha", "doc_id"])
    apart = several.groupBy("sha").agg(F.min("bytes").alias("x"), F.max("bytes").alias("y")).filter("x <> y").limit(1).collect()
    if apart:
        raise ValueError(f"texts of digest {apart[0]['sha']} differ")


def add(batch: DataFrame, old: Snapshot | None, docs: DataFrame | None = None) -> DataFrame:
    """The groups of a snapshot and of a new batch together. Only the batch's positives and the snapshot's groups of the
    same digest are merged; what the filters deny passes by. docs: rows of both, for the comparison of bytes."""
    if old is None:
        return batch
    maybe, new = screen(batch, old)
    if docs is not None:
        check_bytes(maybe, old, docs)
    met = old.groups.join(maybe.select("sha"), "sha", "left_semi")
    others = old.groups.join(maybe.select("sha"), "sha", "left_anti")
    return _merged(met.unionByName(maybe)).unionByName(new).unionByName(others)


def dedup(docs: DataFrame, batches: int = 2) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of each row of docs, which come as `batches` batches by a hash of
    doc_id, each screened against the snapshot of those before. Texts are equal when identical without ASCII white space;
    null counts as empty. The row with the most code points stays, then the smallest doc_id. Rows that share the doc_id
    that stays and its length are all kept; a null doc_id comes last. An empty table gives none."""
    rows = stored(digests(docs).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches))), "dedup-digests")
    total = None
    for k in range(batches):
        new = stored(grouped(rows.filter(F.col("batch") == k)), "dedup-batch")
        total = add(new, snapshot(total) if total is not None else None, docs)
    return _decided(rows, stored(total, "dedup-total"))


def _decided(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Groups of one row need no join: only rows of others meet their group."""
    several = groups.filter("rows > 1").select("sha", "size", F.col("best.doc_id").alias("keep_id"), F.col("best.less").alias("less"), F.col("rows").alias("group_size"))
    found = rows.join(several, ["sha", "size"], "left")
    alone = F.col("group_size").isNull()
    kept = alone | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == -F.col("less")))
    return found.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"))
