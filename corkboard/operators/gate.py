"""Gates of edits: what an edit of a class may change of a note's structure, and of an index's counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# How far an edit of each class may move a counter of the index, down and up.
BOUNDS = {
    "fix_unresolved_link": {"unresolved_links": (-1, 0), "verified_edges": (0, 1)},
    "append_at_eof": {},
    "create_new_file": {"notes": (0, 1)},
    "move_to_trash": {"notes": (-1, 0)},
}
COUNTERS = ["notes", "unresolved_links", "verified_edges"]
#: What the parts of a note are compared by: each class that keeps a structure, and which columns must stay at each place.
KEPT = {"fix_unresolved_link": {"heading": ["line", "level", "text"], "section": ["heading", "line_start", "line_end"]}, "append_at_eof": {"heading": ["line", "level", "text"], "section": ["heading", "line_start"]}}


def structure(edits: DataFrame, before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """(path, mutation_class, part, ordinal, reason) of what edits (path, mutation_class) did to their notes' structure though they
    mustn't. before and after have, for "heading" and "section", the parts (path, ordinal and others) of the notes, in order.

    fix_unresolved_link keeps every part at its place: lost, added, changed. append_at_eof keeps those that there were, though the last
    section may end later: lost, changed. Other classes, and notes that weren't there before, are kept to nothing. The two lists of
    a note are aligned by ordinal, one join a part, so a note's parts never meet in one row."""
    found = []
    for part in ("heading", "section"):
        for kind, columns in KEPT.items():
            own = edits.filter(F.col("mutation_class") == kind).select("path", "mutation_class").distinct()
            known = before["heading"].select("path").unionByName(before["section"].select("path")).distinct()  # a note without parts before may get any
            own = own.join(known, "path", "left_semi")
            sides = [x[part].join(own, "path").select("path", "mutation_class", "ordinal", F.struct(*columns[part]).alias(name)) for x, name in ((before, "was"), (after, "now"))]
            met = sides[0].join(sides[1], ["path", "mutation_class", "ordinal"], "full_outer")
            added = F.when(F.col("was").isNull(), "added") if kind == "fix_unresolved_link" else F.lit(None).cast("string")
            reason = F.coalesce(F.when(F.col("now").isNull(), "lost"), added, F.when(F.col("was") != F.col("now"), "changed"))
            found.append(met.select("path", "mutation_class", F.lit(part).alias("part"), "ordinal", reason.alias("reason")).filter("reason IS NOT NULL"))
    return reduce(DataFrame.unionByName, found)


def receipts(edits: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(counter, delta, low, high, within): how far each counter of an index (one row of COUNTERS each, as of Index.statistics) moved,
    and how far the edits (mutation_class) together may move it."""
    bounds = [(kind, c, *BOUNDS.get(kind, {}).get(c, (0, 0))) for kind in BOUNDS for c in COUNTERS]
    table = edits.sparkSession.createDataFrame(bounds, "mutation_class string, counter string, low long, high long")
    counted = edits.groupBy("mutation_class").agg(F.count("*").alias("n"))  # a row a class
    allowed = table.join(F.broadcast(counted), "mutation_class", "left").groupBy("counter").agg(*[F.sum(F.col(c) * F.coalesce("n", F.lit(0))).alias(c) for c in ("low", "high")])

    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("counter"), F.col(c).cast("long").alias(name)) for c in COUNTERS])))

    met = long(before, "was").join(long(after, "now"), "counter").join(allowed, "counter")
    delta = F.col("now") - F.col("was")
    return met.select("counter", delta.alias("delta"), "low", "high", delta.between(F.col("low"), F.col("high")).alias("within"))


def missing_targets(edits: DataFrame, after: DataFrame) -> DataFrame:
    """(path) of edited files, but for those moved to the trash, that a manifest (path) afterwards lacks."""
    return edits.filter("mutation_class <> 'move_to_trash'").select("path").distinct().join(after.select("path"), "path", "left_anti")
