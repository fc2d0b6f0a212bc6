"""Task contracts: what a task may see of an index, within one budget of characters, with what was left out told in numbers.

A specification is read strictly. Its notes are looked up, and one that is excluded is an error. Retrieval widens by doubling, over
postings that are stored once, until enough hits aren't excluded. Then one budget is folded over all that is emitted, in order:
the operator's texts, cited passages, hits, connections. What is folded is bounded by the specification's own limits.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from corkboard.functions.storage import stored
from corkboard.functions.text import citation, name_key, sanitised
from corkboard.operators import contract, graph
from corkboard.operators.index import Index
from corkboard.operators.search import Ranking

# Names and limits of a specification, the sizes of what is cited, and the most hits that are looked at.
KEYS = {"spec_version", "task_id", "objective", "retrieval", "constraints", "prior_decisions", "acceptance_criteria", "exclusions"}
RETRIEVAL = {"query": (str, 1, 1000), "limit": (int, 1, 50), "include_candidates": (bool, None, None), "max_characters": (int, 1, 100_000)}
ITEMS, CRITERION, STATEMENT, PASSAGE, OBJECTIVE, TASK_ID, EXCLUSIONS = 50, 500, 500, 500, 2000, 128, 200
MOST_HITS, EDGES, LEAST_LEFT = 200, 200, 80


@dataclass(frozen=True)
class Ref:
    """A text of the operator's, or a note, of which a section may be named by its heading and a statement given."""

    text: str | None = None
    note: str | None = None
    heading: str | None = None
    statement: str | None = None


@dataclass(frozen=True)
class Task:
    objective: str
    task_id: str | None = None
    query: str | None = None
    limit: int = 8
    include_candidates: bool = False
    max_characters: int = 8000
    constraints: tuple[Ref, ...] = ()
    prior_decisions: tuple[Ref, ...] = ()
    acceptance_criteria: tuple[str, ...] = ()
    paths: tuple[str, ...] = ()
    globs: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    directives: tuple[str, ...] = ()


def _value(where: str, value, kind: type, least: int | None, most: int | None):
    """value, if it is of the kind (a number is no truth value) and, itself or its length, from least to most."""
    if type(value) is not kind:
        raise ValueError(f"{where} must be of type {kind.__name__}")
    size = value if kind is int else len(value) if kind in (str, list) else None
    if size is not None and not (least or 0) <= size <= (size if most is None else most):
        raise ValueError(f"{where} must have {least} to {most}")
    return value


def _object(where: str, value, keys) -> dict:
    if type(value) is not dict or (unknown := sorted(set(value) - set(keys))):
        raise ValueError(f"{where} must be an object" if type(value) is not dict else f"{where} has unknown keys: {', '.join(unknown)}")
    return value


def _ref(where: str, item) -> Ref:
    item = _object(where, item, ("text", "note", "heading", "statement"))
    if ("text" in item) == ("note" in item):
        raise ValueError(f"{where} must have a text or a note")
    if "text" in item and len(item) > 1:
        raise ValueError(f"{where}: only a note has a heading or a statement")
    limits = {"text": (1, None), "note": (1, None), "heading": (0, None), "statement": (0, STATEMENT)}
    return Ref(**{k: _value(f"{where}.{k}", v, str, *limits[k]) for k, v in item.items() if v is not None or k in ("text", "note")})


def _once(pairs: list) -> dict:
    if len({k for k, _ in pairs}) < len(pairs):
        raise ValueError("a key is given twice")
    return dict(pairs)


def read_task(text: str | bytes, version: str | None = None) -> Task:
    """A task from JSON, read strictly: ValueError for unknown and repeated keys, wrong types and sizes, another version."""
    spec = _object("the specification", json.loads(text.decode("utf-8-sig") if isinstance(text, bytes) else text, object_pairs_hook=_once), KEYS)
    if "spec_version" in spec and spec["spec_version"] != version:
        raise ValueError(f"specifications of version {spec['spec_version']!r} aren't read")
    told = {"objective": _value("objective", spec.get("objective"), str, 1, OBJECTIVE)}
    if spec.get("task_id") is not None:
        told["task_id"] = _value("task_id", spec["task_id"], str, 1, TASK_ID)
        if not re.fullmatch(r"[A-Za-z0-9._:\-]+", told["task_id"]):
            raise ValueError("task_id has other characters than letters, digits and ._:-")
    if "retrieval" in spec:
        retrieval = _object("retrieval", spec["retrieval"], RETRIEVAL)
        if "query" not in retrieval:
            raise ValueError("retrieval needs a query")
        told |= {k: _value(f"retrieval.{k}", v, *RETRIEVAL[k]) for k, v in retrieval.items()}
    for name in ("constraints", "prior_decisions"):
        told[name] = tuple(_ref(f"{name}[{i}]", item) for i, item in enumerate(_value(name, spec.get(name, []), list, 0, ITEMS)))
    criteria = _value("acceptance_criteria", spec.get("acceptance_criteria", []), list, 0, ITEMS)
    told["acceptance_criteria"] = tuple(_value(f"acceptance_criteria[{i}]", c, str, 1, CRITERION) for i, c in enumerate(criteria))
    for name, values in _object("exclusions", spec.get("exclusions") or {}, ("paths", "globs", "tags", "directives")).items():
        told[name] = tuple(_value(f"exclusions.{name}[{i}]", v, str, 1, CRITERION) for i, v in enumerate(_value(f"exclusions.{name}", values, list, 0, EXCLUSIONS)))
    return Task(**told)


def _cut(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.regexp_replace(F.substring(text, 1, most - 1), r"\s+$", ""), F.lit("…"))).otherwise(text)


def selected(held: Index, refs: list[tuple[str, int, Ref]], out: DataFrame) -> list[Row]:
    """For each reference (section, place, ref) to a note: (section, place, note_id, path, citation, passage, statement). A note is
    its path, in any case, or, without a slash, its one name; the section that of the heading, or the first. ValueError where
    there is none or several, or the note is one of `out`. As many rows as references."""
    spark = held.spark
    rows = [(kind, place, r.note.replace("\\", "/"), r.heading, r.statement) for kind, place, r in refs if r.note is not None]
    wanted = F.broadcast(spark.createDataFrame(rows, "section string, place int, value string, heading string, statement string"))
    notes = held.notes().select("note_id", "path")
    direct = notes.join(wanted, F.lower("path") == F.lower("value")).groupBy("section", "place").agg(F.count("*").alias("direct"), F.min("note_id").alias("by_path"))
    named = held.names().join(wanted.select("section", "place", name_key(F.col("value")).alias("key")), "key").select("section", "place", F.col("n").alias("named"), F.col("id").alias("by_name"))
    met = wanted.join(F.broadcast(direct), ["section", "place"], "left").join(F.broadcast(named), ["section", "place"], "left")
    by_path, by_name = F.col("direct") == 1, ~F.col("value").contains("/") & (F.col("named") == 1)
    met = stored(met.withColumn("note_id", F.when(by_path, F.col("by_path")).when(by_name, F.col("by_name"))), "references")
    for r in met.filter("note_id IS NULL").collect():
        raise ValueError(f"{'several notes have' if (r.named or 0) > 1 else 'no note has'} the name or path {r.value}")
    for r in out.join(F.broadcast(met.select("note_id", "value")), "note_id").collect():
        raise ValueError(f"the note {r.value} is named, and excluded by {r.reason}")
    own = held.sections().join(F.broadcast(met.select("section", "place", "note_id", F.col("heading").alias("asked"), "statement")), "note_id")
    own = own.filter(F.col("asked").isNull() | (F.lower("heading") == F.lower("asked")))
    first = own.groupBy("section", "place").agg(F.count("*").alias("n"), F.min_by(F.struct("note_id", "line_start", "line_end", "text", "asked", "statement"), "section_id").alias("s"))
    passage = _cut(sanitised(F.coalesce(F.col("s.text"), F.lit(""))), PASSAGE)
    told = first.join(notes.select(F.col("note_id").alias("id"), sanitised(F.col("path")).alias("path")), F.col("s.note_id") == F.col("id"))
    told = told.select("section", "place", "n", "id", "path", citation(F.col("path"), F.col("s.line_start"), F.col("s.line_end")).alias("citation"), passage.alias("passage"), F.col("s.asked").alias("asked"), _cut(sanitised(F.coalesce(F.col("s.statement"), passage)), STATEMENT).alias("statement")).collect()
    if len(told) < len(rows) or any(r.n > 1 and r.asked is not None for r in told):
        raise ValueError("a note has no section, none of the heading that is asked for, or several")
    return told


@dataclass
class Bundle:
    """items: (place, section, note_id, other_id, path, citation, text, characters, truncated, evidence_class, verified), in the
    document's order; totals: one row of the budget, of what was suppressed, and of what is disclosed."""

    items: DataFrame
    totals: DataFrame


_ITEM = "section string, place int, note_id long, other_id long, path string, citation string, text string, cost int, evidence_class string, verified boolean"


def build(held: Index, task: Task, edges: DataFrame, evidence: DataFrame | None = None, whole: bool = False) -> Bundle:
    """The contract of a task. edges are graph.all_edges; evidence has (source_id, target_id, characters) of what candidates' passages
    and headings take, if candidates are asked for. Hits are ranked by the postings of Ranking.best, if whole by all.

    ValueError for a note that is named though excluded, for operator's texts and cited passages beyond the budget, and for an edge
    that the index's own text doesn't bear out. Hits and connections that are excluded are suppressed and counted: sections once,
    edges at the hits' notes, and the notes that either would have told of."""
    spark = held.spark
    out = stored(contract.excluded(held.notes(), held.tags(), task.paths, task.globs, task.tags), "excluded")
    refs = [(kind, i, r) for kind, group in (("constraint", task.constraints), ("prior_decision", task.prior_decisions)) for i, r in enumerate(group)]
    cited = {(r["section"], r["place"]): r for r in selected(held, refs, out)} if any(r.note is not None for _, _, r in refs) else {}
    rows = [("objective", 0, None, None, None, None, task.objective, None, "authored_by_operator", False)]
    for kind, i, r in refs:
        c = cited.get((kind, i))
        kind_of = "cited_passage" if c is not None and r.statement is None else "authored_by_operator"
        rows.append((kind, i, c["id"] if c else None, None, c["path"] if c else None, c["citation"] if c else None, c["statement"] if c else r.text, None, kind_of, False))
        if c is not None:
            rows.append((f"{kind}_passage", i, c["id"], None, c["path"], c["citation"], c["passage"], None, "cited_passage", False))
    rows += [("acceptance_criterion", i, None, None, None, None, t, None, "authored_by_operator", False) for i, t in enumerate(task.acceptance_criteria)]
    rows += [("directive", i, None, None, None, None, t, None, "authored_by_operator", False) for i, t in enumerate(task.directives)]
    fixed = spark.createDataFrame(rows, _ITEM)
    long = F.col("section").isin("constraint", "prior_decision") & (F.col("evidence_class") == "authored_by_operator")
    text = sanitised(F.col("text"))
    fixed = stored(fixed.withColumn("text", F.when(long, _cut(text, STATEMENT)).otherwise(text)).withColumn("cost", F.length("text")), "operator-texts")
    used = fixed.agg(F.coalesce(F.sum("cost"), F.lit(0))).first()[0]
    if used > task.max_characters:
        raise ValueError(f"the operator's texts and cited passages take {used} characters, more than the budget of {task.max_characters}")

    hits, gone_sections, gone_notes = _retrieved(held, task, out, whole)
    ranking, best = hits
    passages = ranking.hits(best).select(F.lit("retrieved_context").alias("section"), F.col("rank").alias("place"), "note_id", F.lit(None).cast("long").alias("other_id"), sanitised(F.col("path")).alias("path"), citation(sanitised(F.col("path")), F.col("line_start"), F.col("line_end")).alias("citation"), sanitised(F.coalesce("text", F.lit(""))).alias("text")) if best else fixed.limit(0).select("section", "place", "note_id", "other_id", "path", "citation", "text")
    passages = passages.withColumns({"cost": F.length("text"), "evidence_class": F.lit("lexical_match"), "verified": F.lit(False)})
    kept = stored(_folded(passages, task, used, True), "context")
    seeds = kept.filter("accepted").select("note_id").distinct()
    marked = contract.marked_edges(edges, seeds, out, task.include_candidates)
    allowed = marked.filter("NOT source_out AND NOT target_out").orderBy(*graph.edge_order()).limit(EDGES)
    costs = evidence.select("source_id", "target_id", "characters") if evidence is not None else spark.createDataFrame([], "source_id long, target_id long, characters int")
    allowed = stored(allowed, "allowed")
    numbered = allowed.join(costs, ["source_id", "target_id"], "left").withColumn("cost", F.when(F.col("is_verified"), 0).otherwise(F.coalesce("characters", F.lit(0))).cast("int"))
    order = [F.when(F.col("is_verified"), 0).otherwise(1), -F.col("score"), F.col("source_id"), F.col("line"), F.col("place"), F.col("target_id")]
    numbered = numbered.withColumn("nth", F.row_number().over(Window.orderBy(*order)))  # EDGES rows
    ends = numbered.select(F.lit("connection").alias("section"), F.col("nth").alias("place"), F.col("source_id").alias("note_id"), F.col("target_id").alias("other_id"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("citation"), F.col("kind").alias("text"), "cost", F.when(F.col("is_verified"), "authored_link").otherwise("discovery_candidate").alias("evidence_class"), F.col("is_verified").alias("verified"))
    spent = used + kept.filter("accepted").agg(F.coalesce(F.sum("characters"), F.lit(0))).first()[0]
    linked = stored(_folded(ends, task, spent, False), "connections")
    whole = fixed.withColumns({"characters": F.col("cost"), "accepted": F.lit(True), "truncated": F.lit(False)})
    every = whole.unionByName(kept).unionByName(linked)
    items = stored(every.filter("accepted").drop("accepted", "cost"), "items")
    refused = kept.unionByName(linked).filter("NOT accepted OR truncated").isEmpty()
    notes_gone = contract.suppressed_ends(marked).unionByName(spark.createDataFrame([(i,) for i in gone_notes], "note_id long")).distinct().count()
    return Bundle(items, _totals(items, task, len(gone_sections), marked.filter("source_out OR target_out").count(), notes_gone, not refused))


def _retrieved(held: Index, task: Task, out: DataFrame, whole: bool) -> tuple[tuple, set[int], set[int]]:
    """((ranking, the first `limit` hits that aren't excluded), sections that were, their notes): over MOST_HITS hits at most, twice as
    many each time."""
    if task.query is None:
        return (None, []), set(), set()
    ranking, step, gone, notes = Ranking(held, task.query), max(2 * task.limit, 1), set(), set()
    while True:
        hits = ranking.best(step, whole)
        ids = [r["note_id"] for r in hits]
        refused = {r["note_id"] for r in out.filter(F.col("note_id").isin(ids)).select("note_id").collect()}  # step rows at most
        gone |= {r["section_id"] for r in hits if r["note_id"] in refused}
        notes |= refused
        kept = [r for r in hits if r["note_id"] not in refused]
        if len(kept) >= task.limit or len(hits) < step or step >= MOST_HITS:
            return (ranking, kept[: task.limit]), gone, notes
        step = min(2 * step, MOST_HITS)


def _folded(items: DataFrame, task: Task, used: int, passages: bool) -> DataFrame:
    """items with characters, accepted and truncated: in order while the budget lasts. A passage that doesn't fit is cut to end in
    an ellipsis, but for one after the first with fewer than LEAST_LEFT characters left, which ends the list, as does whatever else
    doesn't fit. Of at most MOST_HITS items."""
    listed = items.agg(F.sort_array(F.collect_list(F.struct("place", *[c for c in items.columns if c != "place"]))).alias("items"))

    def step(s: Column, i: Column) -> Column:
        left = F.lit(task.max_characters) - s.used
        if passages:
            end = s.ended | (left <= 0) | ((s.n > 0) & (left < LEAST_LEFT))
            cut = F.length(i.text) > left
            text = F.when(cut, F.concat(F.regexp_replace(F.substr(i.text, F.lit(1), F.greatest(left - 1, F.lit(0))), r"\s+$", ""), F.lit("…"))).otherwise(i.text)
            size = F.length(text)
        else:
            end, cut, text, size = s.ended | (left <= 0) | (i.cost > left), F.lit(False), i.text, i.cost
        told = F.struct(F.when(end, 0).otherwise(size).alias("characters"), (~end).alias("accepted"), (cut & ~end).alias("truncated"), text.alias("text"), i.alias("item"))
        return F.struct((s.used + F.when(end, 0).otherwise(size)).alias("used"), (s.n + 1).alias("n"), end.alias("ended"), F.concat(s.out, F.array(told)).alias("out"))

    fields = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in [items.schema["place"], *[items.schema[c] for c in items.columns if c != "place"]])
    start = F.struct(F.lit(used).cast("int").alias("used"), F.lit(0).alias("n"), F.lit(False).alias("ended"), F.array().cast(f"array<struct<characters: int, accepted: boolean, truncated: boolean, text: string, item: struct<{fields}>>>").alias("out"))
    told = listed.select(F.explode(F.aggregate("items", start, step, lambda s: s.out)).alias("x"))
    return told.select(*[(F.col("x.text") if c == "text" else F.col(f"x.item.{c}")).alias(c) for c in items.columns], "x.characters", "x.accepted", "x.truncated")


def _totals(items: DataFrame, task: Task, sections: int, edges: int, notes: int, cut: bool) -> DataFrame:
    told = F.col("section").isin("retrieved_context", "constraint_passage", "prior_decision_passage")
    text = F.coalesce(F.max(told & (F.length("text") > 0)), F.lit(False))
    about = F.coalesce(F.max(told), F.lit(False)) | F.lit(bool(task.paths or task.tags))
    profile = F.when(text, "task_scoped_bounded_passages").when(about, "task_scoped_metadata").otherwise("empty_contract")
    return items.agg(
        F.lit(task.max_characters).alias("character_budget"), F.sum("characters").alias("characters_used"), F.lit(cut).alias("truncated"), F.lit(sections).alias("suppressed_context"), F.lit(edges).alias("suppressed_connections"),
        F.lit(notes).alias("suppressed_notes"), profile.alias("profile"), text.alias("includes_passage_text"), about.alias("includes_paths_titles_tags"),
        F.coalesce(F.max(F.col("evidence_class") == "discovery_candidate"), F.lit(False)).alias("includes_candidate_edges"),
    )


def check_edges(held: Index, bundle: Bundle, headings: DataFrame) -> None:
    """Refuses a bundle with an authored link that the index's own text doesn't bear out; the edge is named by its notes' ids."""
    ids = bundle.items.filter("evidence_class = 'authored_link'").select(F.col("note_id").alias("source_id"), F.col("other_id").alias("target_id"), F.col("text").alias("kind"))
    claims = held.edges().join(F.broadcast(ids), ["source_id", "target_id", "kind"], "left_semi").select("*", F.lit(True).alias("is_verified"), F.lit(1.0).alias("score"))
    notes = held.notes()
    for r in contract.authored_links_hold(claims, held.sections(), headings, notes, held.names(), graph.paths(notes)).filter("reason IS NOT NULL").limit(1).collect():
        raise ValueError(f"the link from {r.source_id} to {r.target_id} isn't borne out: {r.reason}")
