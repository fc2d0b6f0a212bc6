"""Trail discovery: scores and kinds of candidate connections and notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corkboard.functions.storage import stored
from corkboard.operators.contract import citation_place
from corkboard.operators.graph import both_ways, bridges, degrees, percentile
from corkboard.operators.search import age_days

# The days that notes may lie apart, that a note must have drifted or slept, and the least evidence.
PARALLEL_DAYS, DRIFT_DAYS, DORMANT_DAYS, EVIDENCE_FLOOR = 14, 90, 180, 0.25
PARTS = ["novelty", "distance", "evidence", "centrality", "structure", "age"]


def evidence_score(terms: Column, passages: Column, tags: Column, mutual: Column) -> Column:
    return 0.4 * F.least(terms / 6, F.lit(1.0)) + 0.3 * passages + 0.2 * tags + 0.1 * F.least(mutual / 3, F.lit(1.0))


def trail_score(novelty: Column, distance: Column, evidence: Column, centrality: Column, surprise: Column, penalty: Column) -> Column:
    """Weighted total, floored at 0."""
    return F.greatest(F.lit(0.0), 0.3 * novelty + 0.25 * distance + 0.25 * evidence + 0.1 * centrality + 0.1 * surprise - penalty)


def islands(edges_degrees: DataFrame, candidates: DataFrame, notes: DataFrame) -> DataFrame:
    """Notes of one authored link at most and two candidates at least."""
    ends = candidates.select(F.col("l").alias("note_id")).unionByName(candidates.select(F.col("r").alias("note_id")))
    counted = ends.groupBy("note_id").agg(F.count("*").alias("candidates")).filter("candidates >= 2")
    return notes.select("note_id").join(counted, "note_id").join(edges_degrees, "note_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0))).filter("degree <= 1").select("note_id", "candidates", "degree")


def dormant(notes: DataFrame, candidates: DataFrame, as_of: str, least_days: int = 180) -> DataFrame:
    """Notes untouched for `least_days` at as_of, with a candidate; and how long, as a share of a year."""
    ends = candidates.select(F.col("l").alias("note_id")).unionByName(candidates.select(F.col("r").alias("note_id"))).distinct()
    days = age_days(as_of, F.col("updated_at"))
    old = notes.select("note_id", days.alias("days")).filter(F.col("days") >= least_days).join(ends, "note_id", "left_semi")
    return old.withColumn("age_bonus", F.round(0.15 * F.least(F.col("days") / 365, F.lit(1.0)), 6))


def _met(pairs: DataFrame, near: DataFrame, sizes: DataFrame) -> DataFrame:
    """(l, r, other): for each pair, the notes next to both. Those next to the end that has fewer are looked up at the other, so
    that a hub's neighbours aren't paired with all that it is paired with."""
    ends = pairs.select("l", "r").distinct()
    for end in "lr":
        ends = ends.join(sizes.select(F.col("me").alias(end), F.col("n").alias(f"n{end}")), end)
    few = F.col("nl") <= F.col("nr")
    each = ends.select("l", "r", F.when(few, F.col("l")).otherwise(F.col("r")).alias("me"), F.when(few, F.col("r")).otherwise(F.col("l")).alias("far")).join(near, "me")
    return each.select("l", "r", "far", "other").join(near.select(F.col("me").alias("far"), "other"), ["far", "other"], "left_semi").select("l", "r", "other")


def linked_within(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct pairs (l, r) that at most three links join, either way.

    Of a pair, first the two notes themselves and their neighbours in common; what is left is linked by three links if some
    neighbour of one end is linked with the other end's neighbour. There the neighbours of the end that has fewer go on as (other,
    far end), each such pair once however many pairs lead to it, and these are met in the same way: by the end that has fewer
    neighbours. So the work follows the pairs and their ends of lower degree; a hub's two-step ball is never made."""
    near = stored(both_ways(edges).select("me", "other").distinct(), "neighbours")
    sizes = stored(near.groupBy("me").agg(F.count("*").alias("n")), "degrees")
    pairs = stored(pairs.select("l", "r").distinct(), "pairs")
    one = pairs.join(near.select(F.col("me").alias("l"), F.col("other").alias("r")), ["l", "r"], "left_semi").unionByName(pairs.filter("l = r"))
    two = _met(pairs, near, sizes).select("l", "r")
    close = stored(one.unionByName(two).distinct(), "linked")
    rest = pairs.join(close, ["l", "r"], "left_anti")
    for end in "lr":
        rest = rest.join(sizes.select(F.col("me").alias(end), F.col("n").alias(f"n{end}")), end)
    few = F.col("nl") <= F.col("nr")
    steps = rest.select("l", "r", F.when(few, F.col("l")).otherwise(F.col("r")).alias("me"), F.when(few, F.col("r")).otherwise(F.col("l")).alias("far")).join(near, "me").select("l", "r", "other", "far")
    steps = stored(steps.select("l", "r", F.least("other", "far").alias("a"), F.greatest("other", "far").alias("b")), "steps")
    reached = _met(steps.select(F.col("a").alias("l"), F.col("b").alias("r")), near, sizes).select(F.col("l").alias("a"), F.col("r").alias("b")).distinct()
    return close.unionByName(steps.join(reached, ["a", "b"], "left_semi").select("l", "r")).distinct()


def evidenced(ranked: DataFrame, passages: DataFrame, notes: DataFrame, edges: DataFrame, most: int = 12) -> DataFrame:
    """ranked (l, r, terms) with shared_tags, mutual (the first `most` notes linked to both), passages (whether both sides have
    one) and cited (whether each side's citation is of its own note). passages are those of discovery.best_passages."""
    near = both_ways(edges).select("me", "other").distinct()
    both = _met(ranked, near, near.groupBy("me").agg(F.count("*").alias("n")))
    few = both.withColumn("k", F.row_number().over(Window.partitionBy("l", "r").orderBy("other"))).filter(F.col("k") <= most)
    mutual = few.groupBy("l", "r").agg(F.sort_array(F.collect_list("other")).alias("mutual"))
    own = passages.join(notes.select("note_id", "path"), "note_id").withColumn("own", F.coalesce(citation_place(F.col("citation"))["path"] == F.col("path"), F.lit(False)))
    told = own.groupBy("l", "r").agg((F.count_if(F.col("passage") != "") == 2).alias("passages"), (F.count_if("own") == 2).alias("cited"))
    out = ranked.join(mutual, ["l", "r"], "left").join(told, ["l", "r"], "left")
    for end in "lr":
        out = out.join(notes.select(F.col("note_id").alias(end), F.transform("tags", F.lower).alias(f"{end}_tags")), end)
    no = F.lit(False)
    return out.select("l", "r", "terms", F.array_intersect("l_tags", "r_tags").alias("shared_tags"), F.coalesce("mutual", F.array().cast("array<bigint>")).alias("mutual"), F.coalesce("passages", no).alias("passages"), F.coalesce("cited", no).alias("cited"))


def label_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits of two characters at least, each once."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) > 1))


def domain(of: Column) -> Column:
    return F.coalesce(F.when(of != "", of), F.lit("Unclassified"))


def crossings(edges: DataFrame, notes: DataFrame) -> DataFrame:
    """(a, b, n): how many authored links join notes of two domains, a before b."""
    ends = edges.select("source_id", "target_id")
    for end in ("source", "target"):
        ends = ends.join(notes.select(F.col("note_id").alias(f"{end}_id"), domain(F.col("domain")).alias(end)), f"{end}_id", "left").withColumn(end, F.coalesce(end, F.lit("Unclassified")))
    return ends.filter("source <> target").groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.count("*").alias("n"))


def facts(candidates: DataFrame, notes: DataFrame, edges: DataFrame, crossed: DataFrame) -> DataFrame:
    """candidates (l, r, terms, shared_tags, mutual and others) with what kinds and scores follow from: both domains and dates,
    apart (no three links join them), far (of two domains), rare (which one link at most joins), surprise (terms that
    neither label has), count (of the conditions of a surprise that hold)."""
    side = notes.select(
        "note_id", domain(F.col("domain")).alias("domain"), F.col("created_at").cast("timestamp").alias("created"), F.col("modified_at").cast("timestamp").alias("modified"),
        label_tokens(F.concat_ws(" ", "title", "path", F.array_join("tags", " "), "domain")).alias("label"),
    )
    met = candidates.withColumn("terms", F.array_distinct(F.transform("terms", F.lower)))
    for end in ("l", "r"):
        met = met.join(side.select(*[F.col(c).alias(end if c == "note_id" else f"{end}_{c}") for c in side.columns]), end)
    met = met.join(linked_within(candidates, edges).withColumn("linked", F.lit(True)), ["l", "r"], "left")
    met = met.withColumns({"a": F.least("l_domain", "r_domain"), "b": F.greatest("l_domain", "r_domain")}).join(crossed.select("a", "b", F.col("n").alias("crossed")), ["a", "b"], "left")
    met = met.withColumns({"far": F.col("l_domain") != F.col("r_domain"), "apart": F.col("linked").isNull(), "surprise": F.array_except("terms", F.array_union("l_label", "r_label"))})
    met = met.withColumn("rare", F.col("far") & (F.coalesce("crossed", F.lit(0)) <= 1))
    holds = (F.col("apart"), F.col("rare"), F.size("surprise") >= 2, F.col("apart") & (F.size("terms") >= 3))
    return met.withColumn("count", sum((c.cast("int") for c in holds), F.lit(0))).drop("a", "b", "linked", "crossed", "l_label", "r_label")


def kinds_of(told: DataFrame) -> Column:
    """The kinds of a row of facts."""
    signals = sum((c.cast("int") for c in (F.size("terms") >= 2, F.size("shared_tags") > 0, F.size("mutual") > 0)), F.lit(0))
    near = F.coalesce(F.abs(age_days(F.col("l_created"), F.col("r_created"))) <= PARALLEL_DAYS, F.lit(False))
    rules = {"parallel_invention": F.col("far") & near & (F.size("surprise") >= 2) & (F.col("count") >= 2), "unwritten_link": F.col("apart"), "distant_neighbors": F.col("rare"), "reinforced": (signals >= 2) & (F.col("count") >= 2)}
    return F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules.items()]))


def kinds(candidates: DataFrame, notes: DataFrame, edges: DataFrame, crossed: DataFrame) -> DataFrame:
    """(l, r, kind) of each kind that a candidate (l, r, terms, shared_tags, mutual) is of: parallel_invention,
    unwritten_link, distant_neighbors, reinforced. Notes are (note_id, title, path, tags, domain, created_at, modified_at)."""
    told = facts(candidates, notes, edges, crossed)
    return told.select("l", "r", F.explode(kinds_of(told)).alias("kind"))


def total(penalty: Column | float = 0.0) -> Column:
    """The score of a row of PARTS; age counts beside the floored total."""
    weighted = trail_score(*[F.col(c) for c in ("novelty", "distance", "evidence", "centrality", "structure")], F.lit(penalty) if isinstance(penalty, float) else penalty)
    return F.greatest(F.lit(0.0), weighted + F.col("age"))


def central(notes: DataFrame, edges: DataFrame) -> tuple[DataFrame, float, float]:
    """((note_id, degree) of all notes, the degrees' 90th and 95th percentile)."""
    held = notes.select("note_id").join(degrees(edges), "note_id", "left").select("note_id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))
    held = stored(held, "degrees")
    p90, p95 = ((percentile(held, "degree", share).first()["value"] or 0) for share in (0.9, 0.95))
    return held, p90, p95


def _centrality(degree: Column, p90: float) -> Column:
    return F.least(degree / float(p90), F.lit(1.0)) if p90 else F.lit(0.0)


def scored(candidates: DataFrame, notes: DataFrame, edges: DataFrame, as_of: str) -> DataFrame:
    """(l, r, kind, PARTS, score, surprise) of candidates (l, r, terms, shared_tags, mutual, passages, cited) of two surprising
    terms at least, of evidence at the floor or above, and cited on both sides. No feedback is taken off."""
    held, p90, _ = central(notes, edges)
    told = facts(candidates, notes, edges, crossings(edges, notes))
    told = told.withColumn("evidence", evidence_score(F.size("terms").cast("double"), F.when(F.col("passages"), 1.0).otherwise(0.0), F.when(F.size("shared_tags") > 0, 1.0).otherwise(0.0), F.size("mutual").cast("double")))
    told = told.filter((F.size("surprise") >= 2) & (F.col("evidence") >= EVIDENCE_FLOOR) & F.col("cited"))
    for end in "lr":
        told = told.join(held.select(F.col("note_id").alias(end), F.col("degree").alias(f"{end}_degree")), end)
    older = F.greatest(F.lit(0.0), *[F.coalesce(age_days(as_of, F.col(f"{end}_modified")), F.lit(0.0)) for end in "lr"])
    parts = {
        "novelty": F.when(F.col("apart"), 1.0).otherwise(0.0), "distance": F.when(~F.col("far"), 0.0).when(F.col("rare"), 1.0).otherwise(0.6),
        "centrality": _centrality(F.greatest("l_degree", "r_degree"), p90), "structure": F.lit(0.0), "age": 0.15 * F.least(older / 365, F.lit(1.0)),
    }
    told = told.withColumns(parts)
    return told.withColumn("kind", F.explode(kinds_of(told))).select("l", "r", "kind", *PARTS, total().alias("score"), "surprise")


def structural(notes: DataFrame, edges: DataFrame, candidates: DataFrame, as_of: str | None, hashes_changed: int = 0) -> DataFrame:
    """(note_id, kind, PARTS, score) of single notes: bridge, island, dormant (only where as_of is known) and drift. The last
    counts for more when an export before, whose claims hold, tells of changed contents."""
    held, p90, _ = central(notes, edges)
    ends = candidates.select(F.col("l").alias("note_id")).unionByName(candidates.select(F.col("r").alias("note_id")))
    counted = ends.groupBy("note_id").agg(F.count("*").alias("candidates"))
    over = bridges(edges, notes).select("note_id", F.lit(True).alias("bridge"))
    n = notes.select("note_id", F.col("created_at").cast("timestamp").alias("created"), F.col("modified_at").cast("timestamp").alias("modified")).join(held, "note_id").join(counted, "note_id", "left").join(over, "note_id", "left")
    n = n.withColumn("candidates", F.coalesce("candidates", F.lit(0))).withColumn("centrality", _centrality(F.col("degree"), p90))
    slept = F.greatest(F.lit(0.0), age_days(as_of, F.col("modified")))
    span = age_days(F.col("modified"), F.col("created"))

    def year(days: Column) -> Column:
        return F.least(days / 365, F.lit(1.0))

    one = F.lit(1.0)
    rules = {
        "bridge": (F.col("bridge"), 0.0, 1.0, one), "island": ((F.col("degree") <= 1) & (F.col("candidates") >= 2), 0.2, 0.0, one),
        "dormant": ((slept >= DORMANT_DAYS) & (F.col("candidates") >= 1), 0.0, 0.0, F.least(one, 0.4 + year(slept))),
        "drift": ((span >= DRIFT_DAYS) & (F.col("candidates") >= 1), 0.0, 0.0, F.least(one, 0.5 + (0.2 if hashes_changed > 0 else 0.0) + year(span) * 0.3)),
    }
    each = [F.when(rule, F.struct(F.lit(kind).alias("kind"), F.lit(novelty).alias("novelty"), F.lit(distance).alias("distance"), structure.alias("structure"))) for kind, (rule, novelty, distance, structure) in rules.items()]
    met = n.select("note_id", "centrality", F.inline(F.array_compact(F.array(*each)))).withColumns({"evidence": F.lit(0.0), "age": F.lit(0.0)})
    return met.select("note_id", "kind", *PARTS, total().alias("score"))


def drift(notes: DataFrame, candidates: DataFrame, least_days: int = DRIFT_DAYS) -> DataFrame:
    """(note_id, days) of notes (created_at, modified_at) changed `least_days` after they were made, with a candidate."""
    ends = candidates.select(F.col("l").alias("note_id")).unionByName(candidates.select(F.col("r").alias("note_id")))
    days = age_days(F.col("modified_at"), F.col("created_at"))
    return notes.select("note_id", days.alias("days")).filter(F.col("days") >= least_days).join(ends, "note_id", "left_semi")
