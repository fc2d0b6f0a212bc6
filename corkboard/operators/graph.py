"""Links, resolution, neighbourhoods, paths and graph export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corkboard.functions.markdown import body
from corkboard.functions.storage import small, stored
from corkboard.functions.text import inline_tags, link_target, markdown_links, name_key, path_key, wikilinks
from corkboard.operators.changes import digest_of

TAG_FANOUT = 100
NEIGHBOURS = 1000
LINE_END = "\r\n|\r|\n"


def bodies(notes: DataFrame) -> DataFrame:
    """notes (note_id, path, title, text) with b: what functions.markdown.body tells of each text; null texts are empty."""
    return notes.select("note_id", "path", "title", F.coalesce("text", F.lit("")).alias("text")).withColumn("b", body(F.col("text")))


def links_of(text: Column, first: Column) -> Column:
    """Structs (line, place, kind, target, source_text) of a text whose first line has the number `first`; place counts within a
    line, wiki links before Markdown links before tags."""

    def marked(found: Column, kind: str) -> Column:
        return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("target")))

    def of_line(t: Column, i: Column) -> Column:
        each = F.concat(marked(wikilinks(t), "wikilink"), marked(markdown_links(t), "markdown_link"), marked(inline_tags(t), "tag"))
        told = F.transform(each, lambda x, k: F.struct((i + first).alias("line"), k.alias("place"), x.kind.alias("kind"), x.target.alias("target"), F.regexp_replace(t, r"^\s+|\s+$", "").alias("source_text")))
        return F.when(t.rlike(r"\[\[|\]\(|#"), told)

    return F.flatten(F.array_compact(F.transform(F.split(text, LINE_END), of_line)))


def links(notes: DataFrame) -> DataFrame:
    """(note_id, path, line, place, kind, target, source_text) of wiki links, Markdown links and tags outside frontmatter and
    fences, and of the frontmatter's tags, in no order. CRLF, CR and LF end lines, nothing else does."""
    told = bodies(notes)
    own = F.transform("b.tags", lambda t, k: F.struct(F.col("b.tag_line").alias("line"), k.alias("place"), F.lit("tag").alias("kind"), t.alias("target"), F.lit(None).cast("string").alias("source_text")))
    return told.select("note_id", "path", F.inline(F.concat(links_of(F.col("b.text"), F.lit(1)), own)))


def names(notes: DataFrame) -> DataFrame:
    """(key, n, id): look-up keys of titles, file names and aliases, with the number of notes that have each, and one of them.
    Names without a letter from a to z or a digit have no key and name nothing."""
    told = bodies(notes)
    keys = F.concat(F.array(name_key(F.col("title")), name_key(F.col("path"))), F.transform("b.aliases", name_key))
    each = told.select("note_id", F.explode(F.array_distinct(keys)).alias("key")).filter("key <> ''")
    return each.groupBy("key").agg(F.count_distinct("note_id").alias("n"), F.min("note_id").alias("id"))


def paths(notes: DataFrame) -> DataFrame:
    """(key, id): look-up keys of paths; of paths of one key, the last note's."""
    return notes.groupBy(path_key(F.col("path")).alias("key")).agg(F.max("note_id").alias("id"))


def resolve(found: DataFrame, names: DataFrame, paths: DataFrame) -> DataFrame:
    """Links (note_id, path, kind, target and others) with target_id or a reason: not_found, ambiguous, path_not_found,
    ambiguous_path, path_outside_vault. A target with a slash, or that begins with a dot, is a path, whatever the kind of the
    link: it is looked up from the top and from the linking note's folder, unless from the top it leads outside. Others are
    names, which must be one note's."""
    columns = found.columns
    found = found.withColumn("bare", link_target(F.col("target")))
    found = found.withColumn("is_path", F.col("bare").contains("/") | F.col("bare").startswith("."))
    folder = F.regexp_extract("path", "^(.*/)[^/]*$", 1)
    near = F.when(F.col("bare").startswith("/"), F.col("bare")).otherwise(F.concat(folder, "bare"))
    found = found.withColumn("name", F.when(~F.col("is_path"), F.nullif(name_key(F.col("bare")), F.lit("")))).withColumn("top", F.when(F.col("is_path"), path_key(F.col("bare"))))
    found = found.withColumn("outside", (F.col("top") == "..") | F.col("top").startswith("../")).withColumn("near", F.when(F.col("is_path") & ~F.col("outside"), path_key(near)))
    found = found.join(names.select(F.col("key").alias("name"), "n", F.col("id").alias("by_name")), "name", "left")
    found = found.join(paths.select(F.col("key").alias("near"), F.col("id").alias("by_near")), "near", "left").join(paths.select(F.col("key").alias("top"), F.col("id").alias("by_top")), "top", "left")
    two = F.col("by_near").isNotNull() & F.col("by_top").isNotNull() & (F.col("by_near") != F.col("by_top"))
    by_path = F.coalesce("by_near", "by_top")
    reason = F.when(~F.col("is_path"), F.when(F.col("n").isNull(), "not_found").when(F.col("n") > 1, "ambiguous")).otherwise(F.when(F.col("outside"), "path_outside_vault").when(two, "ambiguous_path").when(by_path.isNull(), "path_not_found"))
    return found.withColumn("reason", reason).withColumn("target_id", F.when(F.col("reason").isNull(), F.when(F.col("is_path"), by_path).otherwise(F.col("by_name")))).select(*columns, "target_id", "reason")


def resolved(notes: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """resolve of the links to notes among `found`, or of notes."""
    found = links(notes) if found is None else found
    return resolve(found.filter("kind <> 'tag'"), names(notes), paths(notes))


def edges_of(resolved: DataFrame) -> DataFrame:
    """(source_id, target_id, kind, line, place, target_text, source_text): verified edges, the first of each kind between two
    notes; none to itself."""
    ok = resolved.filter("target_id IS NOT NULL AND target_id <> note_id")
    first = F.min(F.struct("line", "place", F.col("target").alias("target_text"), "source_text")).alias("first")
    return ok.groupBy(F.col("note_id").alias("source_id"), "target_id", "kind").agg(first).select("source_id", "target_id", "kind", "first.*")


def edges(notes: DataFrame) -> DataFrame:
    return edges_of(resolved(notes))


def unresolved(notes: DataFrame) -> DataFrame:
    return resolved(notes).filter("reason IS NOT NULL").select("note_id", "path", "line", "kind", "target", "reason")


def doctor(notes: DataFrame, limit: int = 100) -> DataFrame:
    """The first unresolved links by path and line, each with the number of all."""
    if limit < 1:
        raise ValueError("a positive limit is needed")
    found = stored(unresolved(notes), "unresolved")
    return found.orderBy("path", "line", "kind", "target").limit(limit).withColumn("total", F.lit(found.count()))


def statistics(notes: DataFrame, sections: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """One row: notes, sections, verified_edges, candidate_edges, note_tags, unresolved_links."""
    found = stored(resolved(notes), "resolved")
    verified = found.filter("target_id IS NOT NULL AND target_id <> note_id").select("note_id", "target_id", "kind").distinct()
    counts = {"notes": notes, "sections": sections, "verified_edges": verified, "candidate_edges": candidates, "note_tags": note_tags(notes), "unresolved_links": found.filter("reason IS NOT NULL")}
    row = [0 if df is None else df.count() for df in counts.values()]
    return notes.sparkSession.createDataFrame([tuple(row)], ", ".join(f"{name} long" for name in counts))


def resolve_note(notes: DataFrame, value: str, names: DataFrame | None = None) -> int:
    """The id of the note of this path, in any case, or, if it has no slash, of this name. ValueError if none or several. names are
    those of the notes where they are stored."""
    path = value.replace("\\", "/")
    direct = notes.filter(F.lower("path") == path.lower()).select("note_id").limit(2).collect()
    if len(direct) == 1:
        return direct[0][0]
    if "/" in path:
        raise ValueError(f"no note has the path {value}")
    held = names if names is not None else globals()["names"](notes)
    named = held.filter(F.col("key") == name_key(F.lit(value))).collect()
    if not named or named[0]["n"] > 1:
        raise ValueError(f"{'several notes have' if named else 'no note has'} the name {value}")
    return named[0]["id"]


def edge_order() -> list[Column]:
    """Verified edges first, then by score, then as a build inserts them: by note, line and place in the line, candidates by
    their notes."""
    return [F.desc("is_verified"), F.desc("score"), F.col("source_id"), F.col("line"), F.col("place"), F.col("target_id")]


def placed(edges: DataFrame) -> DataFrame:
    """edges with line and place, 0 where they tell none."""
    return edges.withColumns({c: F.lit(0) for c in ("line", "place") if c not in edges.columns})


def all_edges(verified: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """(source_id, target_id, kind, is_verified, score, line, place): authored edges (line and place 0 where they tell none), and
    candidates (l, r, score) beside them."""
    zero = F.lit(0).cast("int")
    where = [F.col(c).cast("int").alias(c) if c in verified.columns else zero.alias(c) for c in ("line", "place")]
    out = verified.select("source_id", "target_id", "kind", F.lit(True).alias("is_verified"), F.lit(1.0).alias("score"), *where)
    if candidates is None:
        return out
    return out.unionByName(candidates.select(F.col("l").alias("source_id"), F.col("r").alias("target_id"), F.lit("candidate").alias("kind"), F.lit(False).alias("is_verified"), "score", zero.alias("line"), zero.alias("place")))


def touching(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """The edges with an end among seeds (note_id; few), each once."""
    marks = F.broadcast(seeds.select("note_id").distinct())
    out = edges.join(marks.withColumnRenamed("note_id", "source_id"), "source_id", "left_semi")
    into = edges.join(marks.withColumnRenamed("note_id", "target_id"), "target_id", "left_semi").join(marks.withColumnRenamed("note_id", "source_id"), "source_id", "left_anti")
    return out.unionByName(into)


def incident(edges: DataFrame, seeds: DataFrame, limit: int = 200, notes: DataFrame | None = None) -> DataFrame:
    """The first `limit` edges (of all_edges, by edge_order) at any of seeds (note_id; few), with the number of all and whether the
    limit cut them; with notes (note_id, path, title), both ends' paths and titles beside."""
    found = stored(touching(placed(edges), seeds), "incident")
    total = found.count()
    top = found.orderBy(*edge_order()).limit(limit).withColumn("total", F.lit(total)).withColumn("truncated", F.lit(total > limit))
    if notes is not None:
        top = stored(top, "incident-first")  # limit rows, looked up among the notes
        for end in ("source", "target"):
            top = notes.select(F.col("note_id").alias(f"{end}_id"), F.col("path").alias(f"{end}_path"), F.col("title").alias(f"{end}_title")).join(F.broadcast(top), f"{end}_id")
    return top


def matching(notes: DataFrame, text: str, domain: str | None = None) -> DataFrame:
    """Notes (title, path, domain, tags: array) whose title, path, domain or tags have the text, in any case, and that are of
    the domain, if one is given."""
    label = F.lower(F.concat_ws(" ", "title", "path", "domain", F.array_join("tags", " ")))
    met = notes.filter(F.contains(label, F.lit(text.strip().lower())))
    return met if domain is None else met.filter(F.col("domain") == domain)


def tags_of(links: DataFrame) -> DataFrame:
    """(note_id, tag) of links, lower-cased, each once."""
    return links.filter("kind = 'tag'").select("note_id", F.lower(F.regexp_replace("target", "^#+", "")).alias("tag")).distinct()


def note_tags(notes: DataFrame) -> DataFrame:
    return tags_of(links(notes))


def both_ways(edges: DataFrame) -> DataFrame:
    """(me, other, direction): an edge for each end."""
    out = edges.select(F.col("source_id").alias("me"), F.col("target_id").alias("other"), F.lit("out").alias("direction"))
    return out.unionByName(edges.select(F.col("target_id").alias("me"), F.col("source_id").alias("other"), F.lit("in").alias("direction")))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("me").alias("note_id")).agg(F.count("*").alias("degree"))


def co_tags(tags: DataFrame, note_id: int, fanout: int = TAG_FANOUT) -> DataFrame:
    """(tag, other, note_count, score) of notes that share a tag with one; tags on more than `fanout` notes tell nothing. Only the
    note's own tags are counted, with partial sums, and at most `fanout` notes of each are listed."""
    own = tags.filter(F.col("note_id") == note_id).select("tag").distinct()
    sized = tags.join(F.broadcast(own), "tag").groupBy("tag").agg(F.count("*").alias("note_count")).filter(F.col("note_count") <= fanout)
    met = tags.filter(F.col("note_id") != note_id).join(F.broadcast(sized), "tag")  # as many rows as the note has tags
    return met.select("tag", F.col("note_id").alias("other"), "note_count", F.round(1 / F.log2(F.col("note_count") + 1.0), 6).alias("score"))


def connections(edges: DataFrame, notes: DataFrame, note_id: int, limit: int, tags: DataFrame | None = None) -> DataFrame:
    """(place, other, other_path, direction, kind, verified, score, total) of a note: its edges (of all_edges) by edge_order;
    where these are fewer than limit and tags are given, then notes of a common tag, by the tag's number of notes, the tag and
    the path."""
    if limit < 1:
        raise ValueError("a positive limit is needed")
    spark = notes.sparkSession
    met = incident(edges, spark.createDataFrame([(note_id,)], "note_id long"), limit)
    out = F.col("source_id") == note_id
    order = Window.orderBy(*edge_order())  # limit rows
    items = met.select(F.row_number().over(order).alias("place"), F.when(out, F.col("target_id")).otherwise(F.col("source_id")).alias("other"), F.when(out, "outgoing").otherwise("incoming").alias("direction"), "kind", F.col("is_verified").alias("verified"), "score", "total")
    items = stored(items, "connections")
    n = items.count()
    total = items.first()["total"] if n else 0
    paths = notes.select(F.col("note_id").alias("other"), F.col("path").alias("other_path"))
    if tags is not None:
        shared = stored(co_tags(tags, note_id).join(paths, "other"), "co-tags")
        total += shared.count()
        if n < limit:
            first = shared.orderBy("note_count", "tag", "other_path").limit(limit - n)
            place = F.row_number().over(Window.orderBy("note_count", "tag", "other_path")) + n
            items = items.unionByName(first.select(place.alias("place"), "other", F.lit("supporting").alias("direction"), F.lit("co_tag").alias("kind"), F.lit(False).alias("verified"), "score", F.lit(total).alias("total")))
    return paths.join(F.broadcast(items.withColumn("total", F.lit(total))), "other").select("place", "other", "other_path", "direction", "kind", "verified", "score", "total")


def ranked_ends(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((me, other, rank) of each note's first NEIGHBOURS edges (of all_edges) by edge_order, the first to each other note;
    (me) of notes that have more). Edges beyond them are dropped where they are read, before a hub's meet."""
    edges = placed(edges)
    both = edges.withColumn("ends", F.explode(F.array(*[F.struct(F.col(a).alias("me"), F.col(b).alias("other")) for a, b in (("source_id", "target_id"), ("target_id", "source_id"))])))
    both = both.select("ends.*", *edges.columns)
    first = both.withColumn("rank", F.row_number().over(Window.partitionBy("me").orderBy(*edge_order()))).filter(F.col("rank") <= NEIGHBOURS)
    many = both.groupBy("me").agg(F.count("*").alias("n")).filter(F.col("n") > NEIGHBOURS).select("me")
    return stored(first.groupBy("me", "other").agg(F.min("rank").alias("rank")), "neighbours"), many


def reached(edges: DataFrame, source: int, most_hops: int = 6, target: int | None = None, ends: DataFrame | None = None) -> DataFrame:
    """(note_id, hops, via, way): breadth-first over edges both ways, as a queue would that lists each note's first NEIGHBOURS
    edges (ends, of ranked_ends) in order. way has the rank of each step's edge, so that notes of as many hops are met in the
    order of their ways; via is the note before. Each hop's frontier and what was seen are written, so that a hop is one join
    however many came before; it ends when a hop meets nothing new, or the target."""
    if ends is None:
        told = edges if "kind" in edges.columns else edges.withColumn("kind", F.lit("link"))
        ends = ranked_ends(told if "is_verified" in edges.columns else all_edges(told))[0]
    near = ends
    seen = front = stored(edges.sparkSession.createDataFrame([(source, 0, None, [])], "note_id long, hops int, via long, way array<int>"), "frontier")
    for hop in range(1, most_hops + 1):
        met = near.join(small(front.select(F.col("note_id").alias("me"), "way"), 32 + 8 * hop), "me").select("other", "me", F.concat("way", F.array("rank")).alias("way"))
        new = met.groupBy("other").agg(F.min(F.struct("way", "me")).alias("first"))
        front = stored(new.select(F.col("other").alias("note_id"), F.lit(hop).alias("hops"), F.col("first.me").alias("via"), F.col("first.way").alias("way")).join(seen.select("note_id"), "note_id", "left_anti"), "frontier")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if target is not None and not front.filter(F.col("note_id") == target).isEmpty():
            break
    return seen


def path_between(edges: DataFrame, source: int, target: int, most_hops: int = 6) -> DataFrame:
    """(step, from_id, to_id, kind, verified, score, found, search_truncated): the path that a breadth-first search by edge_order
    meets first, a row a step; one row without a step where there is none of at most most_hops, or source and target are one.
    search_truncated tells whether a note that was looked at before the end has more than NEIGHBOURS edges."""
    if most_hops < 1:
        raise ValueError("a positive number of hops is needed")
    spark, edges = edges.sparkSession, placed(edges)
    ends, many = ranked_ends(edges)
    seen, steps, at = stored(reached(edges, source, most_hops, target if target != source else None, ends), "seen"), [], target
    last = None
    while at != source:  # a row a hop
        row = seen.filter(F.col("note_id") == at).first()
        if row is None:
            steps = []
            break
        last = last or row
        steps.append((row["hops"], row["via"], at, row["way"][-1]))
        at = row["via"]
    looked = seen.filter(F.col("hops") < most_hops)
    if last is not None and steps:  # the note from which the target was met, and all before it
        way = F.lit(last["way"][:-1]).cast("array<int>")
        looked = seen.filter((F.col("hops") < last["hops"] - 1) | ((F.col("hops") == last["hops"] - 1) & (F.col("way") <= way)))
    truncated = not looked.join(many.withColumnRenamed("me", "note_id"), "note_id", "left_semi").isEmpty()
    told = F.broadcast(spark.createDataFrame(steps, "step int, from_id long, to_id long, rank int"))
    both = edges.withColumn("e", F.explode(F.array(*[F.struct(F.col(a).alias("from_id"), F.col(b).alias("to_id")) for a, b in (("source_id", "target_id"), ("target_id", "source_id"))]))).select("e.*", *edges.columns)
    first = F.min_by(F.struct("kind", "is_verified", "score"), F.struct(~F.col("is_verified"), -F.col("score"), "source_id", "line", "place", "target_id"))
    found = both.join(told, ["from_id", "to_id"]).groupBy("step", "from_id", "to_id").agg(first.alias("e"))
    rows = found.select("step", "from_id", "to_id", "e.kind", F.col("e.is_verified").alias("verified"), "e.score", F.lit(True).alias("found"), F.lit(truncated).alias("search_truncated"))
    return rows if steps else spark.createDataFrame([(None, None, None, None, None, None, False, truncated)], rows.schema)


def mutual_pairs(edges: DataFrame) -> DataFrame:
    """(a, b, c): for connected notes, each note that both are connected to. Neighbours are taken of the end that has fewer, and
    looked up at the other, so that a hub's are not paired with all of its edges."""
    near = stored(both_ways(edges).select("me", "other").distinct(), "neighbours")
    sizes = near.groupBy("me").agg(F.count("*").alias("n"))
    ends = edges.select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).distinct()
    for end in "ab":
        ends = ends.join(sizes.select(F.col("me").alias(end), F.col("n").alias(f"n{end}")), end)
    few = F.col("na") <= F.col("nb")
    each = ends.select("a", "b", F.when(few, F.col("a")).otherwise(F.col("b")).alias("me"), F.when(few, F.col("b")).otherwise(F.col("a")).alias("far")).join(near, "me")
    return each.select("a", "b", "far", F.col("other").alias("c")).join(near.select(F.col("me").alias("far"), F.col("other").alias("c")), ["far", "c"], "left_semi").select("a", "b", "c")


def mutual_neighbours(edges: DataFrame) -> DataFrame:
    """(a, b, n): for connected notes, the number of notes that both are connected to."""
    ends = edges.select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).distinct()
    counted = mutual_pairs(edges).groupBy("a", "b").agg(F.count("*").alias("n"))
    return ends.join(counted, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"))


def content_digest(notes: DataFrame) -> DataFrame:
    """One digest of all notes by group, of two levels: of the digests, in order, of 65536 ranges of the sorted digests of
    paths and contents. So no task holds all of a group."""
    each = notes.select("domain", F.sha2(F.concat("path", F.lit(":"), F.sha2("text", 256)), 256).alias("x"))
    return digest_of(each, "domain", "notes")


def bridges(edges: DataFrame, notes: DataFrame) -> DataFrame:
    """Notes whose own links go to notes of two domains at least."""
    out = edges.select("source_id", F.col("target_id").alias("other")).distinct()
    met = out.join(notes.select(F.col("note_id").alias("other"), F.coalesce(F.col("domain").cast("string"), F.lit("Unclassified")).alias("domain")), "other")
    return met.groupBy(F.col("source_id").alias("note_id")).agg(F.count_distinct("domain").alias("domains"), F.count("*").alias("links")).filter("domains >= 2")


def percentile(df: DataFrame, column: str, share: float) -> DataFrame:
    """The value at floor((n - 1) * share) of the sorted values: by counts of equal values, not by a list of all."""
    counts = df.groupBy(column).agg(F.count("*").alias("c"))  # as many rows as distinct values
    run = counts.withColumn("through", F.sum("c").over(Window.orderBy(column))).withColumn("n", F.sum("c").over(Window.partitionBy()))
    return run.filter(F.col("through") > F.floor((F.col("n") - 1) * share)).agg(F.min(column).alias("value"))
