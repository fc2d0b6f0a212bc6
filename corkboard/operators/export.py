"""The graph document: nodes and edges as they are exported, and the checks of a document that is read in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corkboard.functions.text import excerpt, sanitised
from corkboard.operators.graph import degrees, mutual_pairs

# The limits of a document.
LISTED, SUMMARY, NODES, EDGES = 12, 280, 5_000, 12_000


def nodes(notes: DataFrame, edges: DataFrame, sections: DataFrame, excerpts: bool) -> DataFrame:
    """(note_id, path, domain, degree, section_count, content_hash, summary). The summary is of the first section, and null
    unless excerpts are asked for."""
    counted = sections.groupBy("note_id").agg(F.count("*").alias("section_count"), F.min_by("text", "ordinal").alias("first"))
    out = notes.select("note_id", "path", "domain", F.sha2("text", 256).alias("content_hash")).join(degrees(edges), "note_id", "left").join(counted, "note_id", "left")
    summary = excerpt(sanitised(F.col("first")), SUMMARY) if excerpts else F.lit(None).cast("string")
    return out.select("note_id", "path", "domain", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("section_count", F.lit(0)).alias("section_count"), "content_hash", summary.alias("summary"))


def edge_context(edges: DataFrame, tags: DataFrame, most: int = LISTED) -> DataFrame:
    """(source_id, target_id, mutual, mutual_total, shared_tags): the notes next to both ends, the `most` of smallest id
    listed, and the tags that both have. Ranked by windows before they are listed, so a hub's lists stay short."""
    ends = edges.select("source_id", "target_id").distinct()

    def listed(met: DataFrame, key: str) -> DataFrame:
        whole = Window.partitionBy("source_id", "target_id")
        ranked = met.withColumn("k", F.row_number().over(whole.orderBy(key))).withColumn("total", F.count("*").over(whole)).filter(F.col("k") <= most)
        return ranked.groupBy("source_id", "target_id").agg(F.sort_array(F.collect_list(key)).alias("listed"), F.max("total").alias("total"))

    own = tags.select("note_id", "tag").distinct()
    at = ends.withColumn("a", F.least("source_id", "target_id")).withColumn("b", F.greatest("source_id", "target_id"))
    mutual = listed(at.join(mutual_pairs(edges), ["a", "b"]).select("source_id", "target_id", "c"), "c").select("source_id", "target_id", F.col("listed").alias("mutual"), F.col("total").alias("mutual_total"))
    both = ends.join(own.withColumnRenamed("note_id", "source_id"), "source_id").join(own.withColumnRenamed("note_id", "target_id"), ["target_id", "tag"], "left_semi")
    shared = listed(both.select("source_id", "target_id", "tag"), "tag").select("source_id", "target_id", F.col("listed").alias("shared_tags"))
    out = ends.join(mutual, ["source_id", "target_id"], "left").join(shared, ["source_id", "target_id"], "left")
    return out.select("source_id", "target_id", F.coalesce("mutual", F.array().cast("array<bigint>")).alias("mutual"), F.coalesce("mutual_total", F.lit(0)).alias("mutual_total"), F.coalesce("shared_tags", F.array().cast("array<string>")).alias("shared_tags"))


def imported(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, counts) of a document's (position, id, ...) and (position, id, source, target, ...). The first node of
    each id stays; edges need both ends, and of those that have them the first of each id stays. An edge without id is
    named by its place, a node without one is an error. Counts tell how many went, by reason."""
    first = Window.partitionBy("id").orderBy("position")

    place = (F.col("position") + 1).cast("string")
    missing = F.coalesce("id", F.lit("")) == ""
    n = nodes.withColumn("id", F.when(missing, F.raise_error(F.concat(F.lit("no id: node "), place))).otherwise(F.col("id"))).withColumn("k", F.row_number().over(first))
    kept = n.filter("k = 1").drop("k")
    e = edges.withColumn("id", F.when(missing, F.concat(F.lit("edge-"), place)).otherwise(F.col("id")))
    for end in ("source", "target"):
        e = e.join(kept.select(F.col("id").alias(end), F.lit(True).alias(f"has_{end}")), end, "left")
    e = e.withColumn("whole", F.coalesce(F.col("has_source") & F.col("has_target"), F.lit(False)))
    e = e.withColumn("k", F.row_number().over(Window.partitionBy("id", "whole").orderBy("position")))
    gone = e.select(F.when(~F.col("whole"), "dangling_edge").when(F.col("k") > 1, "duplicate_edge").alias("reason"))
    gone = gone.unionByName(n.select(F.when(F.col("k") > 1, "duplicate_node").alias("reason"))).filter("reason IS NOT NULL")
    return kept, e.filter("whole AND k = 1").select(*edges.columns), gone.groupBy("reason").agg(F.count("*").alias("n"))


def check_size(nodes: DataFrame, edges: DataFrame) -> None:
    """A document of too many nodes or edges is refused, not cut."""
    counted = {"nodes": (nodes.limit(NODES + 1).count(), NODES), "edges": (edges.limit(EDGES + 1).count(), EDGES)}
    for name, (n, most) in counted.items():
        if n > most:
            raise ValueError(f"more than {most} {name}")
