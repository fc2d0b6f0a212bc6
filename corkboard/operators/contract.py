"""Task contracts: which notes and edges a selection leaves out, whether claims of evidence hold, and who may write what."""

from __future__ import annotations

import fnmatch
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corkboard.functions.markdown import body
from corkboard.functions.storage import stored
from corkboard.functions.text import UNSAFE, json_length, sanitised
from corkboard.operators.graph import edge_order, links_of, placed, resolve, touching

# Bounds of what is listed, and the classes of changes with those that only add.
EDGES, ENTRIES, CHARACTERS = 200, 1_000, 200_000
CLASSES = ["create_new_file", "append_at_eof", "replace_whole_section", "fix_unresolved_link", "move_to_trash"]
ADDING = ["create_new_file", "append_at_eof"]


def clean_path(path: Column) -> Column:
    """Whether it is a relative path of ordinary parts: from no root or drive, without back-slash, empty part, `.` or `..`."""
    parts = F.split(path, "/")
    return F.coalesce(~path.contains("\\") & ~parts[0].contains(":") & ~F.exists(parts, lambda p: p.isin("", ".", "..")), F.lit(False))


def citation_place(text: Column) -> Column:
    """(path, line_start, line_end) of `path:start-end` with a clean path and 1 <= start <= end; null for others."""
    pattern = r"(?s)^(.*):([0-9]{1,9})-([0-9]{1,9})$"
    path, start, end = (F.regexp_extract(text, pattern, i) for i in (1, 2, 3))
    first, last = start.try_cast("int"), end.try_cast("int")  # no match gives empty texts
    ok = text.rlike(pattern) & clean_path(path) & (first >= 1) & (last >= first)
    return F.when(ok, F.struct(path.alias("path"), first.alias("line_start"), last.alias("line_end")))


def resolved_citations(claims: DataFrame, sections: DataFrame) -> DataFrame:
    """claims (citation and others) with `valid`, whether the citation is one, and `found`, whether a section (path,
    line_start, line_end) has exactly its lines."""
    keys = ["cited_path", "cited_start", "cited_end"]
    held = sections.select(*[F.col(c).alias(k) for c, k in zip(("path", "line_start", "line_end"), keys)]).distinct().withColumn("found", F.lit(True))
    place = citation_place(F.col("citation"))
    placed = claims.withColumns({k: place[c] for k, c in zip(keys, ("path", "line_start", "line_end"))}).withColumn("valid", place.isNotNull())
    return placed.join(held, keys, "left").withColumn("found", F.coalesce("found", F.lit(False))).drop(*keys)


def shared_terms_hold(claims: DataFrame, terms: DataFrame) -> DataFrame:
    """claims (source_id, target_id, terms) with `holds`: whether there are terms and both notes (note_id, term) have each. Of an index's
    packed terms (note_id, terms: array of term and others) only the claims move, to where their notes' terms are."""
    ends = ("source_id", "target_id")
    if "terms" in terms.columns:
        of = [claims.join(terms.select(F.col("note_id").alias(end), F.col("terms.term").alias("own")), end).select(*ends, "terms", F.explode(F.array_intersect("terms", "own")).alias("term")) for end in ends]
        each = of[0].join(of[1], [*ends, "terms", "term"], "left_semi")
    else:
        each = claims.select(*ends, "terms", F.explode(F.array_distinct("terms")).alias("term"))
        own = terms.select("note_id", "term").distinct()
        for end in ends:
            each = each.join(own.withColumnRenamed("note_id", end), [end, "term"], "left_semi")
    met = each.groupBy("source_id", "target_id", "terms").agg(F.count_distinct("term").alias("met"))
    wanted = F.size(F.array_distinct("terms"))
    return claims.join(met, ["source_id", "target_id", "terms"], "left").withColumn("holds", F.coalesce((F.col("met") == wanted) & (wanted > 0), F.lit(False))).drop("met")


def authored_links_hold(claims: DataFrame, sections: DataFrame, headings: DataFrame, notes: DataFrame, names: DataFrame, paths: DataFrame) -> DataFrame:
    """claims of edges (source_id, target_id, kind, is_verified, score, line, source_text, target_text) with `reason`, null where an
    index's own text bears the claim out. self_link, unknown_kind and score are of what no build writes; no_link, where the claimed
    line, as a section of the source (sections: note_id, line_start, line_end, text) or else a heading (headings: note_id, line,
    source_text) has it, isn't the text that is quoted or has no such link; other_target where it resolves to another note, to none
    or to several. Candidates' scores must be in (0, 1]; their links aren't derived.

    Only sources that claims name are parsed again, each section as a whole, so that fences count; what is found is resolved once
    by the build's own rules (notes: note_id, path; names and paths of graph), and met by equality with what is claimed."""
    claimed = claims.select(F.col("source_id").alias("note_id")).distinct()
    at = claims.select(F.col("source_id").alias("note_id"), "line").distinct()
    own = sections.join(claimed, "note_id", "left_semi").select("note_id", "line_start", "line_end", "text")
    # of several sections that cover a line one is taken, as a build makes none that overlap
    first = at.join(own.select("note_id", "line_start", "line_end"), "note_id").filter(F.col("line").between(F.col("line_start"), F.col("line_end")))
    first = stored(first.groupBy("note_id", "line").agg(F.min(F.struct("line_start", "line_end")).alias("s")).select("note_id", "line", "s.*"), "covering")
    told = own.join(first.select("note_id", "line_start", "line_end").distinct(), ["note_id", "line_start", "line_end"], "left_semi")
    found = told.withColumn("b", body(F.col("text"), False)).select("note_id", "line_start", F.inline(links_of(F.col("b.text"), F.col("line_start"))))
    found = found.join(first.select("note_id", "line", "line_start"), ["note_id", "line", "line_start"], "left_semi").select("note_id", "line", "kind", "target", "source_text")
    bare = headings.join(at, ["note_id", "line"], "left_semi").join(first, ["note_id", "line"], "left_anti")
    of_headings = bare.select("note_id", F.inline(links_of(F.col("source_text"), F.col("line")))).select("note_id", "line", "kind", "target", "source_text")
    every = found.unionByName(of_headings).filter("kind <> 'tag'").distinct().join(notes.select("note_id", "path"), "note_id")
    links = resolve(every, names, paths).groupBy(F.col("note_id").alias("source_id"), "line", "kind", F.col("target").alias("target_text"), "source_text").agg(F.max("target_id").alias("means"))
    met = claims.join(links.withColumn("there", F.lit(True)), ["source_id", "line", "kind", "target_text", "source_text"], "left")
    score, verified = F.col("score"), F.col("is_verified")
    rules = {
        "self_link": F.col("source_id") == F.col("target_id"), "unknown_kind": F.when(verified, ~F.col("kind").isin("wikilink", "markdown_link")).otherwise(F.col("kind") != "candidate"),
        "score": F.coalesce(F.isnan(score) | F.when(verified, score != 1.0).otherwise((score <= 0.0) | (score > 1.0)), F.lit(True)),
        "no_link": verified & F.col("there").isNull(), "other_target": verified & ~F.coalesce(F.col("means") == F.col("target_id"), F.lit(False)),
    }
    return met.withColumn("reason", F.coalesce(*[F.when(F.coalesce(rule, F.lit(True)), name) for name, rule in rules.items()])).select(*claims.columns, "reason")


def _folded(values) -> list[str]:
    for v in values:
        if not v or re.search(UNSAFE, v):
            raise ValueError(f"an exclusion is empty or has characters that aren't shown: {v!r}")
    return [v.replace("\\", "/").casefold() for v in values]


def excluded(notes: DataFrame, note_tags: DataFrame, paths=(), globs=(), tags=()) -> DataFrame:
    """(note_id, reason) of notes that a selection leaves out: by their path, else by a glob (in which * goes across slashes),
    else by one of their tags; without regard to case, slashes' direction and characters that aren't shown."""
    paths, globs, tags = _folded(paths), _folded(globs), [t.removeprefix("#") for t in _folded(tags)]
    folded = F.lower(F.replace(sanitised(F.col("path")), F.lit("\\"), F.lit("/")))
    patterns = [f"^{fnmatch.translate(g).removesuffix(r'\Z').removesuffix(r'\z')}\\z" for g in globs]
    globbed = reduce(Column.__or__, [folded.rlike(p) for p in patterns], F.lit(False))
    marked = note_tags.filter(F.lower(F.regexp_replace(sanitised(F.col("tag")), "^#", "")).isin(tags)).select("note_id").distinct()
    met = notes.select("note_id", "path").join(marked.withColumn("tagged", F.lit(True)), "note_id", "left")
    reason = F.when(folded.isin(paths), "excluded_path").when(globbed, "excluded_glob").when(F.col("tagged"), "excluded_tag")
    return met.select("note_id", reason.alias("reason")).filter("reason IS NOT NULL")


def marked_edges(edges: DataFrame, seeds: DataFrame, out: DataFrame, candidates: bool = True) -> DataFrame:
    """The edges (of graph.all_edges) at seeds with source_out and target_out, whether an end is a note of `out`; stored."""
    met = touching(placed(edges if candidates else edges.filter("is_verified")), seeds)
    for end in ("source", "target"):
        met = met.join(out.select(F.col("note_id").alias(f"{end}_id"), F.lit(True).alias(f"{end}_out")).distinct(), f"{end}_id", "left")
    return stored(met.withColumns({f"{end}_out": F.coalesce(f"{end}_out", F.lit(False)) for end in ("source", "target")}), "marked-edges")


def suppressed_ends(marked: DataFrame) -> DataFrame:
    """(note_id) of the notes left out that marked edges meet, each once."""
    return marked.select(F.explode(F.array_compact(F.array(*[F.when(F.col(f"{end}_out"), F.col(f"{end}_id")) for end in ("source", "target")]))).alias("note_id")).distinct()


def allowed_edges(edges: DataFrame, seeds: DataFrame, out: DataFrame, candidates: bool = True, limit: int = EDGES) -> DataFrame:
    """The first `limit` edges (of graph.all_edges) at seeds that touch no note of `out`, by graph.edge_order;
    each with the numbers of edges that `out` suppressed and of its notes met, both of all edges at the seeds."""
    met = marked_edges(edges, seeds, out, candidates)
    suppressed, dropped = met.filter("source_out OR target_out").count(), suppressed_ends(met).count()
    top = met.filter("NOT source_out AND NOT target_out").orderBy(*edge_order()).limit(limit)
    return top.select("source_id", "target_id", "kind", "is_verified", "score", F.lit(suppressed).cast("long").alias("suppressed"), F.lit(dropped).cast("long").alias("dropped"))


def tags_at(edges: DataFrame, seeds: DataFrame, note_tags: DataFrame) -> DataFrame:
    """The tags (note_id, tag) of the notes at either end of the edges at seeds."""
    met = touching(edges, seeds)
    ends = met.select(F.col("source_id").alias("note_id")).unionByName(met.select(F.col("target_id").alias("note_id"))).distinct()
    return note_tags.join(ends, "note_id", "left_semi")


def bounded(items: DataFrame, column: str, most: int = ENTRIES, characters: int = CHARACTERS) -> DataFrame:
    """(place, column, total): the first texts in order, `most` at most, while their JSON with a separator each is of `characters`
    at most; an entry that doesn't fit ends the list. Only `most` rows meet in a task."""
    total = items.count()
    first = items.select(column).orderBy(column).limit(most)
    order = Window.orderBy(column)
    run = first.withColumn("place", F.row_number().over(order)).withColumn("used", F.sum(json_length(F.col(column)) + 1).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return run.filter(F.col("used") <= characters).select("place", column, F.lit(total).cast("long").alias("total"))


def write_levels(edits: DataFrame, default: str = "require_approval", classes: dict[str, str] | None = None, sources: dict[str, dict[str, str]] | None = None, paths=(), globs=(), terms=(), frontmatter: dict[str, list[str]] | None = None) -> DataFrame:
    """edits (source, path, mutation_class, frontmatter: map of lists) with (level, reason): disabled for protected files and
    unknown classes, else as the source says of the class, else the class, else the default. Nothing but classes that only
    add is applied without being asked about by default."""
    folded = F.lower(F.replace(F.col("path"), F.lit("\\"), F.lit("/")))
    rules = [(folded.isin([p.casefold() for p in paths]), "disabled", "protected:paths")]
    rules += [(folded.rlike(f"^{fnmatch.translate(g.casefold()).removesuffix(r'\Z').removesuffix(r'\z')}\\z"), "disabled", "protected:globs") for g in globs]
    rules += [(folded.contains(t.casefold()), "disabled", "protected:path_terms") for t in terms]
    for key, denied in (frontmatter or {}).items():
        words = F.flatten(F.transform(F.coalesce(F.col("frontmatter")[key], F.array().cast("array<string>")), lambda v: F.split(F.coalesce(v, F.lit("")), ",")))
        bare = F.transform(words, lambda w: F.lower(F.regexp_replace(F.trim(w), "^[\"']+|[\"']+$", "")))
        rules.append((F.arrays_overlap(bare, F.array(*[F.lit(d.casefold()) for d in denied])), "disabled", f"protected:frontmatter:{key}"))
    rules.append((~F.col("mutation_class").isin(CLASSES) | F.col("mutation_class").isNull(), "disabled", "unknown_class"))
    for source, own in (sources or {}).items():
        rules += [((F.col("source") == source) & (F.col("mutation_class") == c), level, "source_override") for c, level in own.items()]
    rules += [(F.col("mutation_class") == c, level, "class_level") for c, level in (classes or {}).items()]
    if default == "auto_apply":
        rules.append((~F.col("mutation_class").isin(ADDING), "require_approval", "auto_apply_clamped"))
    told = F.struct(F.lit(default).alias("level"), F.lit("default").alias("reason"))
    for met, level, reason in reversed(rules):
        told = F.when(met, F.struct(F.lit(level).alias("level"), F.lit(reason).alias("reason"))).otherwise(told)
    return edits.withColumn("told", told).select(*edits.columns, "told.level", "told.reason")
