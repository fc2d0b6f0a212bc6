"""Jaccard join of shingle sets by parity sketches.

A sketch is a very long bit vector in which each shingle of a set toggles one bit, so that two sketches differ in at most as
many bits as the sets differ in shingles. It is cut into k parts, and of each part only the XOR of the hashes of its set bits
is held. Sets linked at similarity s differ in at most D = (1 - s) / (1 + s) * (|A| + |B|) shingles: of k > D parts at least
k - D are equal. Sets are taken in bands of sizes with a k of their own; a set is in its size's band, and in the next where a
set of that band can still be similar.

Parts without a set bit tell nothing. A set with fewer than k - D of them meets each of its partners in a part with bits;
sets with more are joined by their empty parts too, which then both of a pair have. So no linked pair is missed.

Equal sets are one class, told by a 128-bit digest, and only a class's smallest document is joined. In a bucket of equal parts,
each member is compared to one other first; members that links have already brought together need no more comparison. What is
still apart in a bucket is compared in full at last, buckets of the same members once: in a large bucket (of a passage that
many documents share, say) by their sketches' bits, in blocks, so that no pair becomes a row that the sketches rule out. These
sketches are BITS bits a shingle long, so that few of a set's shingles meet in a bit and the distance of bits is nearly that
of the sets.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corkboard.llm.common import row_blocks, scratch, small, stored, trimmed, utf8
from corkboard.llm.kernels import mix, shingles

#: Sizes of a band, last to first.
RATIO = 1.5
#: Rounds in which a bucket's members meet one of them, before those still apart all meet.
STAR_ROUNDS = 2
#: Members of a bucket beyond which sketches are compared in blocks of BLOCK members, not as rows of a join.
LARGE = 16
BLOCK = 1024
#: Documents of a block of texts with one key beyond which all but two of them need not meet the key's others to be kept.
OFTEN = 4
SPREAD = 1 << 10
#: Bits of a compared sketch for each shingle of its band's largest set.
BITS = 4
#: Low bits of a bucket's key that tell its band.
BAND_BITS = 6
#: Pairs of one document that are verified in one go.
GROUP = 64


@functools.lru_cache(maxsize=8)
def bands(percent: int, most: int = 1 << 31) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first sizes, differences allowed, parts) of each band of sizes for links at percent / 100."""
    firsts, allowed, parts, size = [], [], [], 1
    while size < most:
        end = max(size + 1, int(size * RATIO))  # sizes size .. end - 1
        d = (100 - percent) * 2 * (end - 1) // (100 + percent)
        k = d + 3
        for more in range(d + 1, 2 * d + 2, 1 + d // 500):  # room for the empty parts of the band's smallest sets, and some
            empty = more * np.exp(-_smallest(size, percent) / more)
            if more >= d + 1 + empty + 2.5 * np.sqrt(empty):
                k = more
                break
        firsts.append(size)
        allowed.append(d)
        parts.append(k)
        size = end
    return np.array(firsts), np.array(allowed), np.array(parts)


def _smallest(first: int, percent: int) -> int:
    """The smallest set that can be similar to one of size first."""
    return -(-first * percent // 100)


def _sketches(flat: np.ndarray, bounds: np.ndarray, rows: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place in rows, part, where in elements it starts, elements) for each part with elements of some rows' sets, each
    cut in its number of parts."""
    k = parts.astype(np.uint64)
    sizes = bounds[rows + 1] - bounds[rows]
    which = np.repeat(np.arange(len(rows)), sizes)
    x = flat[np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(bounds[rows], sizes)]
    part = ((x >> np.uint64(32)) * k[which]) >> np.uint64(32)  # ascending, as the set is
    new = np.ones(len(x), bool)
    new[1:] = (which[1:] != which[:-1]) | (part[1:] != part[:-1])
    starts = np.flatnonzero(new)
    return which[starts], part[starts], starts, x


def _sketch_keys(flat: np.ndarray, bounds: np.ndarray, rows: np.ndarray, band: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for each part: key is a hash of part and the part's XOR, and the band. Empty parts only of sets with many."""
    _, allowed, parts = bands(percent)
    owner, part, starts, x = _sketches(flat, bounds, rows, parts[band])
    value = np.bitwise_xor.reduceat(mix(x + np.uint64(0x5851F42D4C957F2D)), starts) if len(starts) else np.zeros(0, np.uint64)
    empty = parts[band] - np.bincount(owner, minlength=len(rows))
    for i in np.flatnonzero(empty >= parts[band] - allowed[band]):  # few
        missing = np.setdiff1d(np.arange(parts[band[i]], dtype=np.uint64), part[owner == i])
        owner, part, value = np.append(owner, np.full(len(missing), i)), np.append(part, missing), np.append(value, np.zeros(len(missing), np.uint64))
    key = mix(value ^ mix(part * np.uint64(0x9E3779B97F4A7C15) + band[owner].astype(np.uint64)))
    key = (key >> np.uint64(BAND_BITS) << np.uint64(BAND_BITS)) | band[owner].astype(np.uint64)
    return rows[owner], key.view(np.int64)


def _sketch_bits(flat: np.ndarray, bounds: np.ndarray, rows: np.ndarray, band: np.ndarray, percent: int) -> list[bytes]:
    """Each set's parity sketch, of as many bits as its band has, in words of 64 bits."""
    firsts = np.append(bands(percent)[0], 1 << 31)
    bits = -(-firsts[band + 1] * BITS // 64) * 64
    owner, part, starts, x = _sketches(flat, bounds, rows, bits)
    odd = np.diff(np.append(starts, len(x))) % 2 == 1
    ends = np.concatenate([[0], np.cumsum(bits)])
    out = np.zeros(ends[-1], np.uint8)
    out[ends[owner[odd]] + part[odd].astype(np.int64)] = 1
    packed = np.packbits(out)
    return [packed[a:b].tobytes() for a, b in zip(ends[:-1] // 8, ends[1:] // 8, strict=True)]


def _in_bands(sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, band) of sets: the band of the size, and the next if a set of its sizes can be similar. Sets too small for
    any difference are in none: they are linked with equal ones only."""
    firsts, allowed, _ = bands(percent)
    rows = np.flatnonzero(sizes)
    own = np.searchsorted(firsts, sizes[rows], "right") - 1
    above = (own + 1 < len(firsts)) & (100 * sizes[rows] >= percent * firsts[np.minimum(own + 1, len(firsts) - 1)])
    rows, band = np.concatenate([rows, rows[above]]), np.concatenate([own, own[above] + 1])
    return rows[allowed[band] > 0], band[allowed[band] > 0]


def _blocks(batch, width: int):
    data, offsets = utf8(batch.column("text"))
    for first, end in row_blocks(offsets):
        flat, bounds = shingles(data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first], width)
        yield batch.column("doc_id").slice(first, end - first), flat, bounds


def _segments(ufunc, values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    out = np.zeros(len(bounds) - 1, np.uint64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = ufunc.reduceat(values, bounds[full])
    return out


def classes(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, d1, d2) of each row: the size of its set and a digest, equal for equal sets."""

    @trimmed
    def digested(batches):
        for batch in batches:
            for ids, flat, bounds in _blocks(batch, width):
                d1 = _segments(np.add, mix(flat + np.uint64(0x9E3779B97F4A7C15)), bounds)
                d2 = _segments(np.bitwise_xor, mix(flat ^ np.uint64(0xD1342543DE82EF95)), bounds)
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(bounds)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64))], names=["doc_id", "n_shingles", "d1", "d2"])

    return docs.select("doc_id", "text").mapInArrow(digested, "doc_id long, n_shingles long, d1 long, d2 long")


def _often(key: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """0, or another number for rows whose key is known to be shared: of a key that more than OFTEN rows have, those besides
    its smallest and largest id, which are left to show the key's other documents that it is."""
    order = np.lexsort((ids, key))
    k, d = key[order], ids[order]
    starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(k)))
    hot = (sizes > OFTEN) & (d[starts] != d[starts + sizes - 1])
    free = np.repeat(hot, sizes)
    free[starts] = False
    free[starts + sizes - 1] = False
    out = np.zeros(len(k), np.int32)
    out[order] = np.where(free, 1 + mix(d.astype(np.uint64)) % np.uint64(SPREAD), 0)
    return out


def _buckets(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(key, id, often) for each part of each document's sketches."""

    @trimmed
    def sketched(batches):
        for batch in batches:
            for ids, flat, bounds in _blocks(batch, width):
                names = ids.to_numpy(zero_copy_only=False)
                rows, band = _in_bands(np.diff(bounds), percent)
                for first in range(0, len(rows), 2000):
                    owner, key = _sketch_keys(flat, bounds, rows[first : first + 2000], band[first : first + 2000], percent)
                    own = names[owner].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own), pa.array(_often(key, own))], names=["key", "id", "often"])

    return docs.select("doc_id", "text").mapInArrow(sketched, "key long, id long, often int")


def _sets(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(id, set, sketches): sketches by band, in bits."""
    sketch = pa.struct([("band", pa.int32()), ("bytes", pa.binary())])

    @trimmed
    def listed(batches):
        for batch in batches:
            for ids, flat, bounds in _blocks(batch, width):
                rows, band = _in_bands(np.diff(bounds), percent)
                own: list[list] = [[] for _ in range(len(ids))]
                for first in range(0, len(rows), 2000):
                    r, b = rows[first : first + 2000], band[first : first + 2000]
                    for i, j, x in zip(r, b, _sketch_bits(flat, bounds, r, b, percent), strict=True):
                        own[i].append({"band": int(j), "bytes": x})
                sets = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids, sets, pa.array(own, pa.list_(sketch))], names=["id", "set", "sketches"])

    return docs.select("doc_id", "text").mapInArrow(listed, "id long, set array<long>, sketches array<struct<band: int, bytes: binary>>")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable over edges, for each id of an edge. Large-star and small-star steps in
    turn: every step keeps what is connected, and about a logarithm of the diameter of them ends in stars."""
    pairs = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "links")
    before = None
    while True:
        # large star: larger neighbours move to the smallest one
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = stored(large, "large-star")
        # small star: smaller neighbours, and the node itself, move to the smallest one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small_star = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        pairs = stored(small_star, "small-star")
        state = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _near(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches in a common band don't rule a link out."""
    sketches = sets.select("id", F.size("set").alias("n"), F.explode("sketches").alias("s")).select("id", "n", "s.band", "s.bytes")
    near = small(pairs)
    for side in "ab":
        own = sketches.select(F.col("id").alias(side), F.col("n").alias(f"n{side}"), F.col("bytes").alias(f"s{side}"), "band")
        near = near.join(own, [side] if side == "a" else ["b", "band"])
    near = near.filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))

    def kept(batches):
        for batch in batches:
            most = (100 - percent) * (batch.column("na").to_numpy().astype(np.int64) + batch.column("nb").to_numpy()) // (100 + percent)
            differ = [np.bitwise_count(np.frombuffer(x.as_py(), np.uint64) ^ np.frombuffer(y.as_py(), np.uint64)).sum(dtype=np.int64) for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(np.array(differ, np.int64) <= most))

    return near.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(kept, "a long, b long").distinct()


def _linked(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of near that are linked, by their whole sets. a's set goes once to each GROUP of its pairs."""
    near = stored(near, "jaccard-near")
    salts = stored(near.groupBy("a").agg(F.ceil(F.count("*") / GROUP).alias("salts")), "jaccard-salts")
    salted = near.join(small(salts), "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")))
    right = small(stored(salted.select("a", "salt", "b"), "jaccard-salted")).join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    left = small(salts).join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a").select("a", "sa", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    both = right.join(left, ["a", "salt"])
    na, nb = F.size("sa"), F.size("sb")
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    return both.filter(100 * common >= percent * (na + nb - common)).select("a", "b")


def _star(members: DataFrame, center: Column) -> DataFrame:
    """Of members (key, id, component), each with a member of another component: of those with the least `center` in one
    of its buckets, the one that it shares most buckets with."""
    first = members.groupBy("key").agg(F.min(F.struct(center.alias("o"), "id", "component")).alias("c"))
    met = members.join(first, "key").filter(F.col("component") != F.col("c.component")).groupBy("id", F.col("c.id").alias("other")).agg(F.count("*").alias("n"))
    best = met.groupBy("id").agg(F.max(F.struct("n", (-F.col("other")).alias("other"))).alias("m"))
    return best.select(F.least("id", -F.col("m.other")).alias("a"), F.greatest("id", -F.col("m.other")).alias("b")).distinct()


def _still_apart(members: DataFrame) -> DataFrame:
    """Members of buckets whose members are of more than one component."""
    several = members.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("key")
    return members.join(several, "key", "left_semi")


def _relabelled(members: DataFrame, links: DataFrame) -> DataFrame:
    found = stored(components(links), "components")
    return members.drop("component").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _shared(parts: DataFrame) -> DataFrame:
    """The rows of buckets of more than one document. Those of a key that is often met are known to be, and are spread."""
    w = Window.partitionBy("key", "often")
    return parts.withColumn("lo", F.min("id").over(w)).withColumn("hi", F.max("id").over(w)).filter("often > 0 OR lo <> hi").select("key", "id")


def _once(members: DataFrame) -> DataFrame:
    """members without buckets of a band that have the same members as another one of it."""
    told = members.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("y"))
    first = told.groupBy(F.col("key").bitwiseAND((1 << BAND_BITS) - 1), "n", "x", "y").agg(F.min("key").alias("key"))
    return members.join(first.select("key"), "key", "left_semi")


def _all_apart(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs of a bucket that are of two components and that their sketches don't rule out. Only buckets of LARGE members
    at most make pairs before that."""
    members = stored(_once(stored(_still_apart(members), "jaccard-apart")), "jaccard-once")
    count = members.groupBy("key").agg(F.count("*").alias("n"))
    large = stored(members.join(count.filter(F.col("n") > LARGE).select("key"), "key", "left_semi"), "jaccard-large")
    direct = members.join(count.filter(F.col("n") <= LARGE).select("key"), "key", "left_semi")
    other = direct.select("key", F.col("id").alias("id2"), F.col("component").alias("component2"))
    pairs = direct.join(other, "key").filter("component <> component2 AND id < id2").select(F.col("id").alias("a"), F.col("id2").alias("b"))
    return _near(stored(pairs.distinct(), "jaccard-pairs"), sets, percent).unionByName(_blocks_apart(large, sets, percent)).distinct()


def _blocks_apart(large: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of large buckets, compared block by block: a member goes to each pair of its block with another."""
    count = stored(large.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "jaccard-blocks")
    placed = large.join(small(count), "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    every = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct(F.least("own", o).alias("p"), F.greatest("own", o).alias("q")))
    sketches = sets.select("id", F.size("set").alias("n"), F.explode("sketches").alias("s")).select("id", "n", "s.band", "s.bytes")
    band = F.col("key").bitwiseAND(F.lit((1 << BAND_BITS) - 1)).cast("int")
    rows = placed.withColumn("band", band).join(sketches, ["id", "band"]).select("key", "own", "id", "component", "n", "bytes", F.explode(every).alias("pair")).select("key", "pair.p", "pair.q", "own", "id", "component", "n", "bytes")

    def compared(group: pa.Table) -> pa.Table:
        p, q = group["p"][0].as_py(), group["q"][0].as_py()
        n, own = group["n"].to_numpy(), group["own"].to_numpy()
        order = np.argsort(n, kind="stable")
        group, n, own = group.take(pa.array(order)), n[order].astype(np.int64), own[order]
        ids, component = group["id"].to_numpy(), group["component"].to_numpy()
        bits = np.frombuffer(b"".join(group["bytes"].to_pylist()), np.uint64).reshape(len(n), -1)
        left, right = np.flatnonzero(own == p), np.flatnonzero(own == q)
        x, m, others, other = bits[right], n[right], ids[right], component[right]
        out = [np.zeros((2, 0), np.int64)]
        for i in left:
            near = slice(np.searchsorted(m, -(-n[i] * percent // 100), "left"), np.searchsorted(m, n[i] * 100 // percent, "right"))
            differ = np.bitwise_count(x[near] ^ bits[i]).sum(axis=1, dtype=np.int64)
            ok = (differ <= (100 - percent) * (n[i] + m[near]) // (100 + percent)) & (other[near] != component[i])
            out.append(np.stack([np.minimum(others[near][ok], ids[i]), np.maximum(others[near][ok], ids[i])]))
        a, b = np.unique(np.concatenate(out, axis=1), axis=1)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("key", "p", "q").applyInArrow(compared, "a long, b long")


def join(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs: distinct shingles of `width` words (lower-case A-Z, split at
    ASCII white space; fewer words are one shingle), and the smallest doc_id reachable by links, which are of sets with
    100 * common >= percent * all. Null and empty texts have no shingle and no links, as have rows without doc_id, whose
    component is null. Rows with one doc_id count as one document. An empty table gives none."""
    with scratch() as keep:
        slim = keep(stored(classes(docs, width), "jaccard-classes"))
        real = slim.filter("n_shingles > 0 AND doc_id IS NOT NULL")
        group = stored(real.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "jaccard-groups")
        copies = keep(stored(real.join(group.filter("n > 1"), ["n_shingles", "d1", "d2"]).filter("doc_id <> rep").select("doc_id", "rep").distinct(), "jaccard-copies"))
        found = keep(stored(_classes_linked(docs, copies, width, percent), "jaccard-components"))
    mapped = slim.join(copies, "doc_id", "left").withColumn("id", F.coalesce("rep", "doc_id"))
    return mapped.join(found, "id", "left").select("doc_id", "n_shingles", F.coalesce("component", "id").alias("component_id"))


def _classes_linked(docs: DataFrame, copies: DataFrame, width: int, percent: int) -> DataFrame:
    """(id, component) of the classes' smallest documents that are linked."""
    single = docs.filter(F.col("doc_id").isNotNull()).join(small(copies.select("doc_id")), "doc_id", "left_anti")
    members = stored(_shared(_buckets(single, width, percent)), "jaccard-buckets")
    ids = small(stored(members.select(F.col("id").alias("doc_id")).distinct(), "jaccard-ids"))
    sets = stored(_sets(docs.join(ids, "doc_id", "left_semi"), width, percent).dropDuplicates(["id"]), "jaccard-sets")
    links, apart = None, members.withColumn("component", F.col("id"))
    for k in range(STAR_ROUNDS + 1):
        with scratch() as keep:
            if k < STAR_ROUNDS:
                near = _near(stored(_star(apart, F.xxhash64(F.lit(k), "id") if k else F.col("id")), "jaccard-pairs"), sets, percent)
            else:
                near = _all_apart(apart, sets, percent)
            found = keep(stored(_linked(near, sets, percent), "jaccard-links"))
            links = found if links is None else links.unionByName(found)
            if k < STAR_ROUNDS:
                apart = keep(stored(_still_apart(_relabelled(members, links)), "jaccard-apart"))
                if apart.isEmpty():
                    break
    return components(links)
