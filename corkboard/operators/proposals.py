"""What is proposed for a batch of changes: rewritten links after renames, and reviews of what can't be decided.

A rename's edits are compiled as expressions over the referring file: its bytes must be those that the index knows, it must have
one link to the old name and no other, and what it will be after the edit is told by a digest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corkboard.functions.storage import stored
from corkboard.functions.text import MARKDOWN_LINK, WIKILINK, citation, link_destination, name_key, path_key
from corkboard.operators import changes
from corkboard.operators.graph import LINE_END

BOM = "﻿"
#: Each line with its end, whatever that is.
LINES = r"(?<=\n)|(?<=\r)(?!\n)"


def _found(line: Column, pattern: str) -> Column:
    """Structs (whole, inner) of a pattern's matches and of their first groups."""
    return F.arrays_zip(F.regexp_extract_all(line, F.lit(pattern), F.lit(0)).alias("whole"), F.regexp_extract_all(line, F.lit(pattern), F.lit(1)).alias("inner"))


def _occurrences(raw: Column, old_path: Column, folder: Column) -> Column:
    """How many links of a file mean the old path: wiki links by its name, Markdown links by its path from the top or from the
    file's folder."""
    own, key = name_key(old_path), path_key(old_path)

    def of_line(t: Column) -> Column:
        wiki = F.filter(F.regexp_extract_all(t, F.lit(WIKILINK), F.lit(1)), lambda x: name_key(x) == own)
        bare = F.transform(F.regexp_extract_all(t, F.lit(MARKDOWN_LINK), F.lit(1)), lambda x: F.regexp_replace(link_destination(x), "#.*$", ""))
        marked = F.filter(bare, lambda x: (path_key(x) == key) | (path_key(F.concat(folder, x)) == key))
        return F.size(wiki) + F.size(marked)

    return F.aggregate(F.split(raw, LINE_END), F.lit(0), lambda n, t: n + F.when(t.rlike(r"\[\[|\]\("), of_line(t)).otherwise(0))


def rename_edits(renamed: DataFrame, edges: DataFrame, index: DataFrame, files: DataFrame) -> DataFrame:
    """(old_path, new_path, referrer, kind, line, reason, precondition_hash, old_text, replacement_text, predicted_hash): for each
    authored link to a renamed note (renamed: old_path, new_path, candidates, of changes.renames; those of one candidate) an edit,
    or the reason why there is none. edges are verified ones (source_id, target_id, kind, line, target_text), index has (note_id,
    path, content_hash), files (path, content: binary) what there is now.

    Reasons: content_hash_drift, where the file isn't what the index knows; undecodable; multiple_occurrences_manual_review, unless
    exactly one link of the file means the old note; line_out_of_range, link_not_found_verbatim; target_not_filename_form for a
    wiki link by an alias; target_not_path_form and markdown_link_form_unsupported for a Markdown link that isn't the old path as it
    is. A wiki link gets the new file's name, or its path where another indexed note has that name."""
    one = renamed.filter("candidates = 1").select("old_path", "new_path", name_key(F.col("new_path")).alias("key"), name_key(F.col("old_path")).alias("old_key"))
    stems = index.groupBy(name_key(F.col("path")).alias("key")).agg(F.count("*").alias("same"))  # a number a name, however many have it
    known = index.select(F.col("path").alias("new_path"), F.lit(1).alias("known"))
    one = one.join(stems, "key", "left").join(known, "new_path", "left")
    others = F.coalesce("same", F.lit(0)) - (F.col("key") == F.col("old_key")).cast("int") - F.coalesce("known", F.lit(0))
    bare = F.regexp_replace("new_path", r"\.[^./]*$", "")
    one = one.select("old_path", "new_path", F.when(others > 0, bare).otherwise(F.regexp_replace(bare, "^.*/", "")).alias("name"))
    told = one.join(index.select(F.col("path").alias("old_path"), F.col("note_id").alias("target_id")), "old_path")
    met = told.join(edges.filter(F.col("kind").isin("wikilink", "markdown_link")).select("source_id", "target_id", "kind", "line", "target_text"), "target_id")
    met = met.join(index.select(F.col("note_id").alias("source_id"), F.col("path").alias("referrer"), "content_hash"), "source_id")
    met = met.join(files.select(F.col("path").alias("referrer"), "content"), "referrer", "left")
    drift = F.coalesce(F.sha2("content", 256) != F.col("content_hash"), F.lit(True))
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    raw = F.when(text.startswith(BOM), F.substr(text, F.lit(2))).otherwise(text)
    met = met.withColumns({"drift": drift, "marked": text.startswith(BOM), "raw": F.when(~drift, raw)}).drop("content")
    lines = F.split("raw", LINES)
    met = met.withColumns({"times": _occurrences(F.col("raw"), F.col("old_path"), F.regexp_extract("referrer", "^(.*/)[^/]*$", 1)), "n_lines": F.size(F.split("raw", LINE_END))})
    ended = F.get(lines, F.col("line") - 1)
    met = met.withColumns({"ended": ended, "told": F.regexp_replace(ended, r"[\r\n]+$", "")})
    wiki = F.col("kind") == "wikilink"
    matches = F.when(wiki, F.filter(_found(F.col("told"), WIKILINK), lambda m: F.trim(m["inner"]) == F.col("target_text"))).otherwise(F.filter(_found(F.col("told"), MARKDOWN_LINK), lambda m: link_destination(m["inner"]) == F.col("target_text")))
    met = met.withColumn("matches", matches).withColumns({"whole": F.get("matches", F.lit(0))["whole"], "inner": F.get("matches", F.lit(0))["inner"]})
    part = F.regexp_extract("target_text", "(?s)^([^#]*)", 1)
    rules = {
        "content_hash_drift": F.col("drift"), "undecodable": F.col("raw").isNull(), "multiple_occurrences_manual_review": F.col("times") != 1,
        "line_out_of_range": ~F.col("line").between(1, F.col("n_lines")), "link_not_found_verbatim": F.size("matches") != 1,
        "target_not_filename_form": wiki & (name_key(F.col("target_text")) != name_key(F.col("old_path"))), "target_not_path_form": ~wiki & (part != F.col("old_path")),
        "markdown_link_form_unsupported": ~wiki & (F.trim("inner") != F.col("target_text")),
    }
    met = met.withColumn("reason", F.coalesce(*[F.when(rule, name) for name, rule in rules.items()]))
    length = F.length("whole")
    moved = F.concat("new_path", F.substr("target_text", F.length(part) + 1))
    new = F.when(wiki, F.concat(F.lit("[["), "name", F.substr("whole", 3 + F.length("inner")))).otherwise(F.concat(F.substr("whole", F.lit(1), length - 1 - F.length("inner")), moved, F.lit(")")))
    sound = F.col("reason").isNull()
    met = met.withColumns({"old_text": F.when(sound, F.col("whole")), "replacement_text": F.when(sound, new)})
    pattern = F.concat(F.lit(r"(?<!!)\Q"), F.replace("old_text", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    quoted = F.replace(F.replace("replacement_text", F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    edited = F.transform(lines, lambda t, i: F.when(i == F.col("line") - 1, F.regexp_replace(F.col("ended"), pattern, quoted)).otherwise(t))
    after = F.concat(F.when(F.col("marked"), BOM).otherwise(""), F.array_join(edited, ""))
    return met.select("old_path", "new_path", "referrer", "kind", "line", "reason", F.col("content_hash").alias("precondition_hash"), "old_text", "replacement_text", F.when(sound, F.sha2(F.encode(after, "UTF-8"), 256)).alias("predicted_hash"))


def proposals(source: str, assessed: DataFrame, edits: DataFrame, inbound: DataFrame, broken: DataFrame, members: DataFrame) -> DataFrame:
    """(proposal_id, source, action, relation, path, edits, grounds) of a source's assessed changes: fix_links_after_rename for a
    path gone from the index of which an edit (of rename_edits) compiles; else review_dangling_references where notes link it
    (inbound: path, other_path); review_broken_citations for paths with citations that no longer hold (broken: path, citation, reason;
    unreadable ones aren't decided); review_duplicates for changed paths whose bytes others have (members, of
    changes.duplicate_members). What nothing
    refers to gets none. grounds counts the referrers, citations or copies; the id is of source, relation, path, action and a digest,
    of two levels, of what the proposal rests on."""
    gone = assessed.filter("relation = 'DELETED'").select("path").distinct()
    sound = edits.filter("reason IS NULL").join(gone.withColumnRenamed("path", "old_path"), "old_path", "left_semi")
    fixed = stored(sound.select(F.col("old_path").alias("path"), "new_path", "referrer", "precondition_hash", "predicted_hash"), "sound-edits")
    parts = []

    def add(action: str, relation: str, counted: DataFrame, values: DataFrame) -> None:
        digests = changes.digest_of(values.distinct().select("path", F.sha2("value", 256).alias("x")), "path", "values")
        parts.append(counted.join(digests, "path").select(F.lit(action).alias("action"), F.lit(relation).alias("relation"), "path", "edits", "grounds", "digest"))

    counted = fixed.groupBy("path").agg(F.count("*").alias("edits"), F.count_distinct("referrer").alias("grounds"))
    add("fix_links_after_rename", "DELETED", counted, fixed.select("path", F.explode(F.array("path", "new_path", "precondition_hash", "predicted_hash")).alias("value")))
    left = stored(inbound.join(gone, "path", "left_semi").join(fixed.select("path").distinct(), "path", "left_anti").select("path", "other_path"), "dangling")
    reviews = {
        "review_dangling_references": ("DELETED", left, "other_path"),
        "review_broken_citations": ("CITATION_BROKEN", broken.filter("reason IN ('note_deleted', 'range_mismatch')"), "citation"),
    }
    for action, (relation, rows, value) in reviews.items():
        add(action, relation, rows.groupBy("path").agg(F.lit(0).cast("long").alias("edits"), F.count("*").alias("grounds")), rows.select("path", F.col(value).alias("value")))
    groups = changes.digest_of(members.select("content_hash", F.sha2("path", 256).alias("x")), "content_hash", "n")  # once a content, whatever its copies
    copies = members.filter("changed").join(groups, "content_hash")
    parts.append(copies.select(F.lit("review_duplicates").alias("action"), F.lit("DUPLICATES_EXACT_BYTES").alias("relation"), "path", F.lit(0).cast("long").alias("edits"), (F.col("n") - 1).alias("grounds"), "digest"))
    every = reduce(DataFrame.unionByName, parts)
    name = F.concat_ws("\u0000", F.lit(source), "relation", "path", "action", "digest")
    return every.select(F.concat(F.lit("prp-"), F.substring(F.sha2(name, 256), 1, 16)).alias("proposal_id"), F.lit(source).alias("source"), "action", "relation", "path", "edits", "grounds")


def broken_in(changed: DataFrame, sections: DataFrame, files: DataFrame) -> DataFrame:
    """(path, citation, reason) of the sections (path, line_start, line_end, text) of an index that no longer hold after a batch of
    changes: note_deleted where the file was removed; range_mismatch where the lines are others now; unreadable where the file
    (path, content: binary) can't be read or isn't UTF-8. Files of which nothing was observed to change aren't looked at, nor those
    whose bytes are no longer what was observed (changed: path, change, new_hash, index_hash)."""
    at = changed.filter("change = 'removed' OR change = 'modified' AND NOT new_hash <=> index_hash").select("path", "change", "new_hash")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.regexp_replace(F.col("content").cast("string"), f"^{BOM}", ""))
    now = files.join(at.select("path"), "path", "left_semi").select("path", F.sha2("content", 256).alias("now_hash"), F.split(text, LINE_END).alias("now"))
    met = sections.select("path", "line_start", "line_end", "text").join(at, "path").join(now, "path", "left")
    start, end = F.col("line_start").cast("int"), F.col("line_end").cast("int")
    outside = (start < 1) | (end > F.size("now")) | (start > end)
    held = F.array_join(F.when(~outside, F.slice("now", start, end - start + 1)), "\n")
    drifted = F.col("now_hash") != F.col("new_hash")
    reason = F.when(F.col("change") == "removed", "note_deleted").when(drifted, None).when(F.col("now").isNull(), "unreadable").when(outside | (held != F.col("text")), "range_mismatch")
    return met.select("path", citation(F.col("path"), start, end).alias("citation"), reason.alias("reason")).filter("reason IS NOT NULL")


def covered(batches: DataFrame, related: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(source, path, state) of assessed paths without a relation whose state still holds, so that they may clear findings of
    before. batches (source, path, batch, change, new_hash) are folded to what the last one says of each path; related (source,
    path) have relations and speak for themselves. A removed path must be absent from the snapshot (source, path, content_hash: null
    where it couldn't be read, or lies behind a link), another one must have there the bytes that were observed."""
    last = batches.groupBy("source", "path").agg(F.max_by(F.struct("change", "new_hash"), "batch").alias("last")).select("source", "path", "last.*")
    left = last.join(related.select("source", "path").distinct(), ["source", "path"], "left_anti")
    met = left.join(snapshot.select("source", "path", F.lit(True).alias("there"), "content_hash"), ["source", "path"], "left")
    gone = (F.col("change") == "removed") & F.col("there").isNull()
    same = (F.col("change") != "removed") & F.coalesce(F.col("content_hash") == F.col("new_hash"), F.lit(False))
    return met.filter(gone | same).select("source", "path", F.when(gone, "absent").otherwise(F.concat(F.lit("present:"), "content_hash")).alias("state"))
