"""Graph documents as JSON: written from tables, read back in two versions, their claims held against what they have.

A document is bounded (export.NODES, export.EDGES); many are written and read at once, each a row, none of them by the driver.
What a document claims of its privacy and of its history is told beside what follows from its nodes and edges.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corkboard.functions.storage import stored
from corkboard.functions.text import SHA256, safe_hash, safe_identifier, safe_label, safe_text, utc_micros
from corkboard.operators.export import EDGES, NODES

# The fields of a document, and how many tags and terms of a node and an edge are read.
VERSIONS = ["viewer.v1", "viewer.v2"]
TAGS, TERMS = 24, 12
SIDE = "struct<citation: string, heading: string, passage: string, truncated: boolean>"
NODE = "struct<id: string, title: string, path: string, status: string, domain: string, summary: string, tags: array<string>, section_count: bigint, created_at: string, modified_at: string, content_hash: string>"
EDGE = (
    "struct<id: string, source: string, target: string, kind: string, verified: boolean, score: double, "
    f"evidence: struct<shared_terms: array<string>, source_text: string, explanation: string, source_evidence: {SIDE}, target_evidence: {SIDE}>>"
)
PRIVACY = "struct<export_profile: string, metadata_only: boolean, includes_excerpts: boolean, includes_passage_text: boolean, includes_note_derived_terms: boolean, includes_paths_titles_tags: boolean, generated_locally: boolean>"
HISTORY = "struct<export_id: string, previous_content_hash: string, node_content_hashes_changed: bigint, node_content_hashes_unchanged: bigint, nodes_added: bigint, nodes_removed: bigint>"
SCHEMA = f"struct<schema_version: string, title: string, generated_at: string, nodes: array<{NODE}>, edges: array<{EDGE}>, privacy: {PRIVACY}, export_history: {HISTORY}>"


def _privacy(nodes: Column, edges: Column) -> dict[str, Column]:
    """What nodes and edges (arrays of NODE and EDGE) disclose."""

    def told(text: Column) -> Column:
        return F.coalesce(text != "", F.lit(False))

    passages = F.exists(nodes, lambda n: told(n.summary)) | F.exists(edges, lambda e: told(e.evidence.source_text) | told(e.evidence.source_evidence.passage) | told(e.evidence.target_evidence.passage))
    terms = F.exists(edges, lambda e: F.coalesce(F.size(e.evidence.shared_terms) > 0, F.lit(False)) | told(e.evidence.explanation))
    profile = F.when(F.size(nodes) == 0, "empty_graph").when(passages, "graph_with_bounded_passage_text").when(terms, "graph_metadata_and_note_derived_terms").otherwise("graph_metadata")
    about = F.exists(nodes, lambda n: told(n.path) | told(n.title) | (F.size(n.tags) > 0))
    return {"export_profile": profile, "metadata_only": ~passages & ~terms, "includes_excerpts": passages, "includes_passage_text": passages, "includes_note_derived_terms": terms, "includes_paths_titles_tags": about}


def history(before: DataFrame, after: DataFrame, node_digest: str = "content_hash") -> DataFrame:
    """(document, previous_content_hash and the counts of HISTORY) of the nodes (document, id, content_hash) of an export and of the one
    before: null and all added where a document has none before. The digest is of the earlier ids and hashes in order."""
    line = F.concat_ws(":", "id", F.coalesce(F.col(node_digest), F.lit("")))
    digest = before.groupBy("document").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("previous_content_hash"))  # NODES at most
    a, b = (x.select("document", "id", F.col(node_digest).alias(n), F.lit(True).alias(f"in_{n}")) for x, n in ((before, "was"), (after, "now")))
    met = a.join(b, ["document", "id"], "full_outer")
    both = F.col("in_was") & F.col("in_now")
    counts = met.groupBy("document").agg(
        F.count_if(both & ~F.col("was").eqNullSafe(F.col("now"))).alias("node_content_hashes_changed"), F.count_if(both & F.col("was").eqNullSafe(F.col("now"))).alias("node_content_hashes_unchanged"),
        F.count_if(F.col("in_was").isNull()).alias("nodes_added"), F.count_if(F.col("in_now").isNull()).alias("nodes_removed"),
    )
    return counts.join(digest, "document", "left").select("document", "previous_content_hash", "node_content_hashes_changed", "node_content_hashes_unchanged", "nodes_added", "nodes_removed")


def documents(nodes: DataFrame, edges: DataFrame, told: DataFrame, version: str = VERSIONS[1], limited: bool = True) -> DataFrame:
    """(document, text): one JSON document for each of `told` (document, title, generated_at, history: HISTORY or null), with its nodes
    (document, position and NODE's fields) and edges (document, position and EDGE's fields) in order, and what they disclose. Of more
    nodes or edges than a document may have it is refused, by an error that names the numbers, unless not limited."""
    out = told.withColumn("schema_version", F.lit(version))
    for name, df, most, kind in (("nodes", nodes, NODES, NODE), ("edges", edges, EDGES, EDGE)):
        fields = [c for c in df.columns if c not in ("document", "position")]
        counted = df.groupBy("document").agg(F.count("*").alias("n"))
        if limited and (over := counted.filter(F.col("n") > most).limit(1).collect()):
            raise ValueError(f"{over[0]['n']} {name} in {over[0]['document']}, more than {most}")
        listed = df.groupBy("document").agg(F.sort_array(F.collect_list(F.struct("position", F.struct(*fields).alias("x")))).alias("l")).select("document", F.transform("l", lambda p: p.x).cast(f"array<{kind}>").alias(name))
        out = out.join(listed, "document", "left").withColumn(name, F.coalesce(name, F.array().cast(f"array<{kind}>")))
    out = stored(out, "documents")
    privacy = F.struct(*[c.alias(n) for n, c in _privacy(F.col("nodes"), F.col("edges")).items()], F.lit(True).alias("generated_locally"))
    body = F.struct("schema_version", "title", "generated_at", "nodes", "edges", privacy.alias("privacy"), F.col("history").alias("export_history"))
    return out.select("document", F.to_json(body, {"ignoreNullFields": "false"}).alias("text"))


@dataclass
class Read:
    """nodes (document, position, id, ...), edges (document, position, id, source, target, ...), and documents: one row each with
    its refusal, or what was dropped, what it discloses and which claims conflict with that."""

    nodes: DataFrame
    edges: DataFrame
    documents: DataFrame


def read(texts: DataFrame, limited: bool = True) -> Read:
    """Reads documents (document, text). refusal is not_json, unsupported_version, no_nodes_or_edges, too_many (if limited), or node_without_id; of
    others the first node of each id stays, edges need both ends, and of those that have them the first of each id stays; an edge
    without id is named by its place. Texts are made safe, hashes and times that aren't are null; a first version has neither, nor
    a history. privacy_conflict: a claim is made and differs from what the document has. history_conflict: a history is given whose
    counts or digest are missing or malformed, or don't add up to the nodes. usable: whether a later export may take it for the
    one before: read whole, with a history that holds where the version has one, ids that don't repeat, and hashes that are none or sound."""
    raw = stored(texts.select("document", F.from_json("text", SCHEMA).alias("d")), "documents-read")
    d = F.col("d")
    version = d["schema_version"]
    ids = F.transform(F.coalesce(d["nodes"], F.array().cast(f"array<{NODE}>")), lambda n: safe_identifier(n.id))
    many = F.lit(limited) & ((F.size(d["nodes"]) > NODES) | (F.size(d["edges"]) > EDGES))
    refusal = (
        F.when(d.isNull() | (version.isNull() & d["nodes"].isNull() & d["edges"].isNull()), "not_json").when(F.coalesce(~version.isin(VERSIONS), F.lit(True)), "unsupported_version").when(d["nodes"].isNull() | d["edges"].isNull(), "no_nodes_or_edges")
        .when(many, "too_many").when(F.exists(ids, lambda i: F.coalesce(i, F.lit("")) == ""), "node_without_id")
    )
    raw = stored(raw.select("document", "d", refusal.alias("refusal"), (version == VERSIONS[1]).alias("second")), "documents-judged")
    good = raw.filter("refusal IS NULL")
    n = good.select("document", "second", F.posexplode("d.nodes").alias("position", "n"))
    label = safe_label(F.col("n.title"))
    when = [F.when(F.col("second"), utc_micros(F.col(f"n.{c}"))).alias(c) for c in ("created_at", "modified_at")]
    ident = safe_identifier(F.col("n.id"))

    def known(text: Column, other: Column | str) -> Column:
        return F.when(F.coalesce(text, F.lit("")) != "", text).otherwise(F.lit(other) if isinstance(other, str) else other)

    tags = F.filter(F.transform(F.coalesce(F.col("n.tags"), F.array().cast("array<string>")), safe_label), lambda t: t != "")
    n = n.select("document", "position", ident.alias("id"), known(label, ident).alias("title"), known(safe_identifier(F.col("n.path")), ident).alias("path"), known(safe_label(F.col("n.domain")), "Unclassified").alias("domain"), F.coalesce(safe_text(F.col("n.summary")), F.lit("")).alias("summary"), F.slice(tags, 1, TAGS).alias("tags"), *when, F.when(F.col("second"), safe_hash(F.col("n.content_hash"))).alias("content_hash"))
    first = n.groupBy("document", "id").agg(F.min("position").alias("position"))
    kept = stored(n.join(first.select("document", "position"), ["document", "position"], "left_semi"), "document-nodes")
    e = good.select("document", F.posexplode("d.edges").alias("position", "e"))
    e = e.select("document", "position", known(safe_identifier(F.col("e.id")), F.concat(F.lit("edge-"), (F.col("position") + 1).cast("string"))).alias("id"), safe_identifier(F.col("e.source")).alias("source"), safe_identifier(F.col("e.target")).alias("target"), known(safe_label(F.col("e.kind")), "connection").alias("kind"), F.coalesce(F.col("e.verified"), F.lit(False)).alias("verified"), "e.score", "e.evidence")
    for end in ("source", "target"):
        e = e.join(kept.select("document", F.col("id").alias(end), F.lit(True).alias(f"has_{end}")), ["document", end], "left")
    e = stored(e.withColumn("whole", F.coalesce(F.col("has_source") & F.col("has_target"), F.lit(False))).drop("has_source", "has_target"), "document-edges")
    once = e.filter("whole").groupBy("document", "id").agg(F.min("position").alias("position"))
    edges = e.filter("whole").join(once.select("document", "position"), ["document", "position"], "left_semi").drop("whole")
    counts = [
        n.groupBy("document").agg(F.count("*").alias("all_nodes"), F.count_distinct("id").alias("n_nodes"), F.max(F.col("summary") != "").alias("summaries")),
        e.groupBy("document").agg(F.count("*").alias("all_edges"), F.count_if(~F.col("whole")).alias("dangling_edges"), F.count_distinct(F.when(F.col("whole"), F.col("id"))).alias("n_edges")),
        edges.groupBy("document").agg(F.max(_disclosed("evidence")).alias("passages"), F.max((F.coalesce(F.size("evidence.shared_terms"), F.lit(0)) > 0) | (F.coalesce("evidence.explanation", F.lit("")) != "")).alias("terms")),
    ]
    out = raw
    for c in counts:
        out = out.join(c, "document", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("all_nodes", "n_nodes", "all_edges", "dangling_edges", "n_edges")}
    out = out.withColumns(zero).withColumns({c: F.coalesce(c, F.lit(False)) for c in ("summaries", "passages", "terms")})
    text = F.col("summaries") | F.col("passages")
    profile = F.when(F.col("n_nodes") == 0, "empty_graph").when(text, "graph_with_bounded_passage_text").when(F.col("terms"), "graph_metadata_and_note_derived_terms").otherwise("graph_metadata")
    actual = {"export_profile": profile, "metadata_only": ~text & ~F.col("terms"), "includes_excerpts": text, "includes_passage_text": text, "includes_note_derived_terms": F.col("terms"), "includes_paths_titles_tags": F.col("n_nodes") > 0}
    conflict = F.lit(False)
    for name, held in actual.items():
        conflict = conflict | F.coalesce(F.col(f"d.privacy.{name}") != held, F.lit(False))
    h = F.col("d.export_history")
    numbers = [h[c] for c in ("node_content_hashes_changed", "node_content_hashes_unchanged", "nodes_added", "nodes_removed")]
    prior = h["previous_content_hash"]
    sound = F.coalesce(h["export_id"], F.lit("")) != ""
    for c in numbers:
        sound = sound & F.coalesce(c >= 0, F.lit(False))
    over = numbers[0] + numbers[1]
    adds = F.when(prior.isNull(), (numbers[2] == F.col("n_nodes")) & (over == 0) & (numbers[3] == 0)).otherwise(prior.rlike(SHA256) & (over + numbers[2] == F.col("n_nodes")))
    holds = F.coalesce(sound & adds, F.lit(False))
    bad_hash = F.exists(F.coalesce(F.col("d.nodes"), F.array().cast(f"array<{NODE}>")), lambda x: F.coalesce(~x.content_hash.rlike(SHA256), F.lit(False)) | (F.coalesce(F.trim(x.title), F.lit("")) == "") | (F.coalesce(F.trim(x.path), F.lit("")) == ""))
    usable = F.col("refusal").isNull() & (~F.col("second") | holds) & (F.col("all_nodes") == F.col("n_nodes")) & ~bad_hash
    told = out.select(
        "document", "refusal", F.col("n_nodes").cast("long"), F.col("n_edges").cast("long"), (F.col("all_nodes") - F.col("n_nodes")).alias("duplicate_nodes"), "dangling_edges", (F.col("all_edges") - F.col("dangling_edges") - F.col("n_edges")).alias("duplicate_edges"),
        F.when(F.col("refusal").isNull(), profile).alias("export_profile"), (F.col("refusal").isNull() & conflict).alias("privacy_conflict"), (F.col("refusal").isNull() & F.col("second") & h.isNotNull() & ~holds).alias("history_conflict"), F.coalesce(usable, F.lit(False)).alias("usable"),
    )
    return Read(kept, edges, told)


def _disclosed(evidence: str) -> Column:
    texts = [F.col(f"{evidence}.{c}") for c in ("source_text", "source_evidence.passage", "target_evidence.passage")]
    out = F.lit(False)
    for t in texts:
        out = out | (F.coalesce(t, F.lit("")) != "")
    return out


def write(docs: DataFrame, path: str) -> None:
    """Documents (of `documents`) as JSON texts, one a line, in a folder."""
    docs.select("text").write.text(path)
