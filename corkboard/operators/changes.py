"""Change data: snapshot differences, renames, copies, touched references, broken citations, proposals, folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corkboard.functions.storage import small, stored


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change, old_hash, new_hash) of what was added, removed or modified; equal hashes are no change."""
    met = before.select("path", F.col("content_hash").alias("old_hash")).join(after.select("path", F.col("content_hash").alias("new_hash")), "path", "full_outer")
    change = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash") != F.col("new_hash"), "modified")
    return met.select("path", change.alias("change"), "old_hash", "new_hash").filter("change IS NOT NULL")


#: Bytes of a folder's path in a set that is broadcast, about.
PATH_BYTES = 256


def observed(before: DataFrame, seen: DataFrame, failed: DataFrame, left_out: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changes as of diff, the snapshot after) of a scan that may have seen less than there is. before and seen are (path,
    content_hash); a null hash means that a file was met but not read whole: what was known of it stays, and what wasn't known
    isn't added. failed (path) are folders that couldn't be listed, the top being the empty path: what was known below them stays.
    left_out (path) are files that the policy doesn't admit any more: they go without being told of as removed. So nothing is
    told to be removed but what a scan would have met. Repeated paths of seen, failed and left_out count once.

    A known path that wasn't met is looked up among the failed folders by each folder above it, not compared with all of them."""
    met = seen.groupBy("path").agg(F.max("content_hash").alias("now")).withColumn("met", F.lit(True))
    out = left_out.select("path").distinct().withColumn("out", F.lit(True))
    every = before.select("path", F.col("content_hash").alias("was")).join(met, "path", "full_outer").join(out, "path", "left")
    every = stored(every.withColumns({"met": F.coalesce("met", F.lit(False)), "out": F.coalesce("out", F.lit(False))}), "scanned")
    missing = every.filter("NOT met AND NOT out").select("path")
    parts = F.split("path", "/")
    above = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    folders = small(stored(failed.select(F.col("path").alias("folder")).distinct(), "failed"), PATH_BYTES)
    unseen = missing.select("path", F.explode(above).alias("folder")).join(folders, "folder", "left_semi").select("path").distinct().withColumn("unseen", F.lit(True))
    told = every.join(unseen, "path", "left")
    stays = (F.col("met") & F.col("now").isNull()) | F.coalesce("unseen", F.lit(False))
    after = F.when(F.col("out"), None).when(stays, F.col("was")).otherwise(F.col("now"))
    told = stored(told.select("path", "was", "out", after.alias("after")), "observed")
    change = F.when(F.col("was").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("was") != F.col("after"), "modified")
    changed = told.filter("NOT out AND (was IS NOT NULL OR after IS NOT NULL)").select("path", change.alias("change"), F.col("was").alias("old_hash"), F.col("after").alias("new_hash")).filter("change IS NOT NULL")
    return changed, told.filter("after IS NOT NULL").select("path", F.col("after").alias("content_hash"))


def renames(changes: DataFrame) -> DataFrame:
    """(old_path, new_path, candidates): a removed path whose hash no other removed one has, with each added path of it."""
    only = changes.filter("change = 'removed'").groupBy(F.col("old_hash").alias("h")).agg(F.count("*").alias("n"), F.min("path").alias("old_path")).filter("n = 1").drop("n")
    added = changes.filter("change = 'added'").select(F.col("path").alias("new_path"), F.col("new_hash").alias("h"))
    counted = added.groupBy("h").agg(F.count("*").alias("candidates"))  # summed before it moves, however many copies there are
    return added.join(only.join(counted, "h"), "h").select("old_path", "new_path", "candidates")


def copies(snapshot: DataFrame) -> DataFrame:
    """(content_hash, paths, first_path) of contents at two paths at least."""
    return snapshot.groupBy("content_hash").agg(F.count("*").alias("paths"), F.min("path").alias("first_path")).filter("paths > 1")


def touched(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(note_id, direction, other) of verified edges at changed notes (note_id)."""
    ends = edges.select(F.col("source_id").alias("note_id"), F.lit("out").alias("direction"), F.col("target_id").alias("other")).unionByName(edges.select(F.col("target_id").alias("note_id"), F.lit("in").alias("direction"), F.col("source_id").alias("other")))
    return ends.join(changed.select("note_id").distinct(), "note_id", "left_semi")


def broken_citations(sections: DataFrame, current: DataFrame) -> DataFrame:
    """Sections (note_id, line_start, line_end, text) whose lines in the current notes (note_id, text) are others now:
    note_deleted where there is no note, unreadable where it has no text, range_mismatch where the lines differ."""
    met = sections.join(current.select("note_id", F.split("text", "\r\n|\r|\n").alias("now"), F.lit(True).alias("there")), "note_id", "left")
    now = F.array_join(F.slice("now", F.col("line_start").cast("int"), (F.col("line_end") - F.col("line_start") + 1).cast("int")), "\n")
    reason = F.when(F.col("there").isNull(), "note_deleted").when(F.col("now").isNull(), "unreadable").when(now != F.col("text"), "range_mismatch")
    return met.select("note_id", "line_start", "line_end", reason.alias("reason")).filter("reason IS NOT NULL")


def assessed(changes: DataFrame, index: DataFrame) -> DataFrame:
    """changes (path, change, old_hash, new_hash) with relation, index_hash and diverged: NEW and MODIFIED for what was added or
    modified and the index (path, content_hash) lacks or has otherwise, index_current for what it has as it is now, DELETED for
    what was removed and it has, never_indexed for what it lacks. A modified path diverged if the index doesn't have what was
    there before."""
    met = changes.join(index.select("path", F.col("content_hash").alias("index_hash")), "path", "left")
    lacks, gone = F.col("index_hash").isNull(), F.col("change") == "removed"
    relation = F.when(gone, F.when(lacks, "never_indexed").otherwise("DELETED")).when(lacks, "NEW").when(F.col("new_hash") == F.col("index_hash"), "index_current").otherwise("MODIFIED")
    diverged = (relation == "MODIFIED") & ~F.col("old_hash").eqNullSafe(F.col("index_hash"))
    return met.select("path", "change", relation.alias("relation"), "old_hash", "new_hash", "index_hash", diverged.alias("diverged"))


def duplicates(changes: DataFrame, index: DataFrame, most: int = 12) -> DataFrame:
    """(path, content_hash, duplicate_of, of_total, in_batch, batch_total) of added and modified paths whose bytes another indexed
    path, or another one of the batch, has: the first `most` other paths, and the number of all. Paths are listed once a content,
    so that many copies don't make pairs; duplicate_members lists all of them."""
    new = changes.filter("change <> 'removed'").select("path", F.col("new_hash").alias("content_hash"))
    out = new
    for name, held in (("of", index.select("path", "content_hash")), ("batch", new)):
        total = held.groupBy("content_hash").agg(F.count("*").alias(f"{name}_n"))
        first = held.withColumn("k", F.row_number().over(Window.partitionBy("content_hash").orderBy("path"))).filter(F.col("k") <= most + 1)
        listed = first.groupBy("content_hash").agg(F.sort_array(F.collect_list("path")).alias(f"{name}_paths"))
        out = out.join(total, "content_hash", "left").join(listed, "content_hash", "left")
    own = index.select("path", "content_hash", F.lit(1).alias("own"))
    out = out.join(own, ["path", "content_hash"], "left")
    others = {name: F.slice(F.filter(F.coalesce(f"{name}_paths", F.array().cast("array<string>")), lambda p: p != F.col("path")), 1, most) for name in ("of", "batch")}
    totals = {"of_total": F.coalesce("of_n", F.lit(0)) - F.coalesce("own", F.lit(0)), "batch_total": F.col("batch_n") - 1}
    return out.withColumns(totals).filter("of_total > 0 OR batch_total > 0").select("path", "content_hash", others["of"].alias("duplicate_of"), "of_total", others["batch"].alias("in_batch"), "batch_total")


def duplicate_members(changes: DataFrame, index: DataFrame) -> DataFrame:
    """(content_hash, path, changed) of every path whose bytes an added or modified path has and another path too, in the index or
    in the batch: a row a path, so that all copies are told without pairs."""
    new = changes.filter("change <> 'removed'").select(F.col("new_hash").alias("content_hash"), "path", F.lit(True).alias("changed"))
    every = new.unionByName(index.select("content_hash", "path", F.lit(False).alias("changed"))).groupBy("content_hash", "path").agg(F.max("changed").alias("changed"))
    shared = every.groupBy("content_hash").agg(F.count("*").alias("n"), F.max("changed").alias("any")).filter("n > 1 AND any").select("content_hash")
    return every.join(shared, "content_hash", "left_semi")


def manifest_digest(entries: DataFrame) -> DataFrame:
    """(source, entries, digest) of checkpoints (source, path, content_hash, size, mtime_ns): every field is bound. Of two levels,
    as graph.content_digest."""
    line = F.concat_ws("\t", "path", "content_hash", F.col("size").cast("string"), F.col("mtime_ns").cast("string"))
    return digest_of(entries.select("source", F.sha2(line, 256).alias("x")), "source", "entries")


def digest_of(each: DataFrame, by: str, count: str) -> DataFrame:
    """(by, count, digest) of rows (by, x): of the digests, in order, of 65536 ranges of x, so that no task holds all of a group."""
    ranges = each.groupBy(by, F.substring("x", 1, 4).alias("range")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("x")), "\n"), 256).alias("d"))
    return ranges.groupBy(by).agg(F.sum("n").alias(count), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("range", "d"))), lambda r: r.d), "\n"), 256).alias("digest"))


def drifted_manifest(before: DataFrame, after: DataFrame, edited: DataFrame) -> DataFrame:
    """(path, change) of what differs between two manifests (path, content_hash) though it isn't among the edited paths."""
    return diff(before, after).join(edited.select("path").distinct(), "path", "left_anti").select("path", "change")


def conflicts(edits: DataFrame) -> DataFrame:
    """(source, path, proposals) of files that more than one proposal edits."""
    return edits.groupBy("source", "path").agg(F.sort_array(F.collect_set("proposal_id")).alias("p")).filter(F.size("p") > 1).select("source", "path", F.array_join("p", " ").alias("proposals"))


def latest(states: DataFrame) -> DataFrame:
    """(source, path, state): what the last batch says of each path."""
    return states.groupBy("source", "path").agg(F.max_by("state", "batch").alias("state"))
