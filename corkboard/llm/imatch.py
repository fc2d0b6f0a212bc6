"""I-Match fingerprints: the terms of a text within a band of document frequency, distinct and sorted, hashed over several
randomised subsets of the lexicon.

The lexicon's terms are dealt at random into the cells of several partitions, of 16, 64, 256 ... cells; sixteen cells of
each partition are the subsets of one scale (the terms in those of a scale are in those of the scale before). A text's own scale is that at which a subset holds about one of its lexicon
terms, as its number of distinct terms and the corpus's share of lexicon terms tell. A fingerprint has this scale and, for
each subset of it and of greater ones in which the text has terms, a hash of these terms in order. Two fingerprints are
compared at the greater one's scale: the share of equal hashes among the subsets in which either has terms.

A fingerprint is a Column of its text: the lexicon, a hash table of 64-bit term hashes in one row, is a scalar subquery, so
that no term of a text becomes a row and nothing but the next document's text moves.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corkboard.llm.common import stored

#: A lexicon term is in this share of the documents at least and at most (and in 2 at least). The lexicon has thus at most the
#: mean number of a document's distinct terms divided by the least share, however many documents there are.
LEAST_SHARE, MOST_SHARE = 0.001, 0.25
SUBSETS = 16
SCALES = 5
HEX = 6
#: Bytes of text in a task that looks up following documents, about; and the most such tasks, beyond which they grow: their bounds
#: come to the driver and go to every task.
TASK_BYTES = 32 << 20
MOST_TASKS = 1 << 15


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def terms(text: Column) -> Column:
    """Distinct runs of letters and digits, lower-cased."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), "")


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def lexicon(docs: DataFrame, n: int) -> tuple[DataFrame, float]:
    """The terms (term) in the band, counted over all n documents, and their share of all documents' distinct terms."""
    least, most = max(2, int(LEAST_SHARE * n)), max(2, int(MOST_SHARE * n))
    counts = docs.select(F.explode(terms(_text())).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    within = F.col("df").between(least, most)
    # a term of one document needs no row of its own: such terms count by what their hash's low bits hold
    kept = counts.groupBy(F.when(within, F.col("term")).alias("term"), F.when(within, F.lit(0)).otherwise(F.pmod(F.xxhash64("term"), F.lit(256))).alias("rest")).agg(F.sum("df").alias("df"))
    kept = stored(kept, "imatch-lexicon")
    told = kept.agg(F.sum("df").alias("all"), F.sum(F.when(F.col("term").isNotNull(), F.col("df"))).alias("band")).first()
    return kept.filter("term IS NOT NULL").select("term"), (told["band"] or 0) / (told["all"] or 1)


def _hash_table(words: DataFrame) -> tuple[Column, int]:
    """A scalar subquery of the lexicon's 64-bit hashes as an array of cells, each null or an array of those that fall in
    it, and the number of cells."""
    cells = 1 << max(4, (4 * words.count()).bit_length())
    placed = words.select(F.xxhash64("term").alias("h")).groupBy(F.pmod("h", F.lit(cells)).alias("cell")).agg(F.collect_set("h").alias("hashes"))
    every = words.sparkSession.range(cells).withColumnRenamed("id", "cell").join(placed, "cell", "left")
    return every.agg(F.sort_array(F.collect_list(F.struct("cell", "hashes"))).alias("t")).select("t.hashes").scalar(), cells


def _dealt(term: Column, scale: Column) -> Column:
    """The term, which is in a subset of this scale, after each subset (in two hex digits) of it and greater ones that holds
    it: a cell that is one is told by low bits of the term's hash that are zero, and which one by bits of the scale's own."""

    def of(h: Column) -> Column:
        subset = [F.shiftrightunsigned(h, 2 * SCALES + 4 * k).bitwiseAND(F.lit(SUBSETS - 1)) + k * SUBSETS for k in range(SCALES)]
        return F.array_compact(F.array(*[F.when((F.lit(k) >= scale) & (h.bitwiseAND(F.lit(4**k - 1)) == 0), F.concat(F.lpad(F.hex(subset[k]), 2, "0"), term)) for k in range(SCALES)]))

    return let(F.xxhash64(term), of)


def _entries(dealt: Column) -> Column:
    """Of each subset with terms, ascending: the subset and HEX digits of a hash of its terms in order."""

    def told(s: Column) -> Column:
        return F.concat(s.out, F.when(s.subset == "", "").otherwise(F.concat(s.subset, F.lower(F.substring(F.lpad(F.hex(s.h), 16, "0"), 17 - HEX, HEX)))))

    def state(subset: Column, h: Column, out: Column) -> Column:
        return F.struct(subset.alias("subset"), h.alias("h"), out.alias("out"))

    def step(s: Column, x: Column) -> Column:
        subset = F.substring(x, 1, 2)
        return F.when(subset == s.subset, state(s.subset, F.xxhash64(s.h, x), s.out)).otherwise(state(subset, F.xxhash64(F.lit(0).cast("long"), x), told(s)))

    return F.aggregate(F.sort_array(dealt), state(F.lit(""), F.lit(0).cast("long"), F.lit("")), step, told)


def fingerprint(text: Column, table: Column, cells: int, share: float) -> Column:
    """Of a text: its scale, a colon, and the entries of this scale and greater ones. share: of lexicon terms in the corpus."""

    def held(t: Column) -> Column:
        h = F.xxhash64(t)
        return F.coalesce(F.array_contains(F.get(table, F.pmod(h, F.lit(cells)).cast("int")), h), F.lit(False))

    def of(all_terms: Column) -> Column:
        scale = F.round(F.log(F.greatest(F.size(all_terms) * F.lit(share), F.lit(1.0)) / SUBSETS) / F.log(F.lit(4.0))).cast("int")

        def told(k: Column) -> Column:
            low = F.get(F.array(*[F.lit(4**j - 1) for j in range(SCALES)]), k)
            dealt = F.flatten(F.transform(F.filter(F.filter(all_terms, lambda t: F.xxhash64(t).bitwiseAND(low) == 0), held), lambda t: _dealt(t, k)))
            return F.concat(k.cast("string"), F.lit(":"), _entries(dealt))

        return let(F.least(F.lit(SCALES - 1), F.greatest(F.lit(0), scale)), told)

    return let(terms(text), of)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, of two fingerprints; 1 where they are equal, as of texts without lexicon terms and of one scale."""
    scale = F.greatest(*[F.substring_index(x, ":", 1).cast("int") for x in (a, b)])
    first = F.lpad(F.hex((scale * SUBSETS).cast("long")), 2, "0")
    last = F.lpad(F.hex((scale * SUBSETS + SUBSETS - 1).cast("long")), 2, "0")
    parts = [F.filter(F.regexp_extract_all(F.substring_index(x, ":", -1), F.lit(f"[0-9A-F]{{2}}[0-9a-f]{{{HEX}}}"), F.lit(0)), lambda e: F.substring(e, 1, 2).between(first, last)) for x in (a, b)]
    equal = F.size(F.array_intersect(*parts))
    subsets = F.size(F.array_union(*[F.transform(p, lambda e: F.substring(e, 1, 2)) for p in parts]))
    return F.when(a == b, 1.0).when(subsets == 0, 0.0).otherwise(equal / F.greatest(subsets, F.lit(1)))


def _place() -> Column:
    """What orders documents: doc_id, null lowest, then a hash of the text."""
    return F.struct(F.col("doc_id").cast("long").alias("i"), F.xxhash64("text").alias("h"))


def _bounds(rows: DataFrame, each: int) -> list:
    """Places about `each` rows apart, ascending: every each-th row of ranges that are sorted apart from one another."""
    places = rows.select(_place().alias("p")).repartitionByRange("p").sortWithinPartitions("p")
    told = stored(places.withColumn("m", F.monotonically_increasing_id()), "imatch-places")
    return sorted(((r["i"], r["h"]) for r in told.filter(F.col("m").bitwiseAND((1 << 33) - 1) % each == each - 1).select("p.*").distinct().toLocalIterator()), key=lambda x: (x[0] is not None, x))


def _bucket(bounds: list) -> Column:
    """How many of the ascending bounds are below a row's place: a binary search in a constant array."""
    if not bounds:
        return F.lit(0)
    told = F.from_json(F.lit(json.dumps([{"i": i, "h": h} for i, h in bounds])), "array<struct<i: bigint, h: bigint>>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])

    def step(found: Column, width: Column) -> Column:
        return F.when(F.coalesce(F.get(told, found + width - 1) < F.col("place"), F.lit(False)), found + width).otherwise(found)

    return F.aggregate(steps, F.lit(0), step)


def _with_next(docs: DataFrame, n: int, size: int) -> DataFrame:
    """docs in buckets of contiguous descending places, each with `next`, the text of the following one (after the last, the
    first); the row after a bucket's last is a copy (ghost) of the next bucket's first. All of a bucket lies in one
    partition and texts move once. Buckets have about TASK_BYTES of text each, and there are twice as many partitions."""
    rows = docs.select("doc_id", _text().alias("text"))
    each = max(1, TASK_BYTES * n // max(size, 1), n // MOST_TASKS)
    bounds = _bounds(rows, each)
    rows = rows.withColumn("place", _place()).withColumn("bucket", _bucket(bounds))
    firsts = stored(rows.groupBy("bucket").agg(F.max("place").alias("place")), "imatch-firsts")  # two numbers a bucket, and MOST_TASKS buckets
    above = Window.orderBy("bucket")  # one narrow row a bucket
    heads = firsts.select("place", F.coalesce(F.lead("bucket").over(above), F.min("bucket").over(Window.partitionBy())).alias("bucket"))
    texts = rows.select("place", "text").join(F.broadcast(heads), "place").groupBy("place", "bucket").agg(F.max("text").alias("text"))
    ghosts = texts.select(F.col("place.i").alias("doc_id"), "text", "place", "bucket")
    both = rows.withColumn("ghost", F.lit(False)).unionByName(ghosts.withColumn("ghost", F.lit(True))).repartition(2 * len(bounds) + 2, "bucket")
    down = Window.partitionBy("bucket").orderBy("ghost", F.col("place").desc(), F.col("text").desc())
    return both.withColumn("row", F.row_number().over(down)).withColumn("next", F.lead("text").over(down))


def compare(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row of docs.

    Edited: the last third of the text gives way to the beginning of the next document's, by descending doc_id, null last,
    equal ids by a hash of the text. Null text counts as empty. A single document is its own next; an empty table gives
    none. Short texts without lexicon terms have the fingerprint `0:`; two such are alike (1)."""
    told = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).first()
    n, size = told["n"], told["size"] or 0
    words, share = lexicon(docs, n)
    table, cells = _hash_table(words)
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.expr("substr(text, 1, length(text) - cast(floor(length(text) / 3) as int))"), F.substr(F.coalesce("next", F.lit("")), F.lit(1), third))
    # The optimiser puts the subquery in the place of `table`, which is used once as `edited` is: no row ever carries the table.
    rows = _with_next(docs, n, size).withColumn("edited", edited).withColumn("table", table)
    found = let(F.col("table"), lambda t: let(F.col("edited"), lambda e: F.struct(F.sha2(F.encode(e, "UTF-8"), 256).alias("sha"), F.transform(F.array(F.col("text"), e), lambda x: fingerprint(x, t, cells, share)).alias("prints"))))
    rows = rows.select("bucket", "row", "ghost", "doc_id", F.length("text").cast("long").alias("n_chars"), found.alias("found"))
    rows = rows.select("bucket", "row", "ghost", "doc_id", "n_chars", F.col("found.sha").alias("edited_sha256"), F.col("found.prints").alias("prints"))
    rows = rows.withColumn("next_print", F.lead(F.col("prints")[0]).over(Window.partitionBy("bucket").orderBy("row"))).filter(~F.col("ghost"))
    rows = rows.select("doc_id", "n_chars", "edited_sha256", F.col("prints")[0].alias("fingerprint"), F.col("prints")[1].alias("edited_fingerprint"), "next_print")
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_print")).alias("near_next"))
