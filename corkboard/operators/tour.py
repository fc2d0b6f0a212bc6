"""A short tour of trails over a graph. What is chosen follows from what was chosen before: each of a few choices is a job that finds
one row of the stored pool of trails, however large that is."""

from __future__ import annotations

import functools
import hashlib
from collections import Counter
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corkboard.functions.storage import stored
from corkboard.operators import trails

# Lengths, limits and penalties of a tour.
LENGTH, PER_KIND, PER_DOMAIN, LEAST_NOTES, LEAST_CANDIDATES, LEAST_TRAILS, DOMAINS = 6, 2, 2, 8, 3, 3, 3
DISMISSED, REPEATED = 0.2, 0.15
MOST_FEEDBACK = 500
OPENING, STRUCTURAL, EARLY = {"bridge", "island"}, {"bridge", "island", "dormant", "drift"}, {"unwritten_link", "distant_neighbors"}
PLACES = ["bridge", "island", "dormant", "drift", "parallel_invention", "unwritten_link", "distant_neighbors", "reinforced"]


@dataclass(frozen=True)
class Trail:
    kind: str
    l: int
    r: int
    parts: dict[str, float]
    surprise: tuple[str, ...]
    domains: frozenset[str]
    hub: bool

    @property
    def ends(self) -> frozenset[int]:
        return frozenset((self.l, self.r))

    @property
    def digest(self) -> str:
        return pair_digest(*self.ends) if len(self.ends) == 2 else pair_digest(self.l)


@dataclass
class Feedback:
    """What a reader was shown and dismissed, as pair digests; and, while a tour is walked, what it has used."""

    shown: set[str] = field(default_factory=set)
    dismissed: set[str] = field(default_factory=set)
    kinds: Counter = field(default_factory=Counter)
    domains: Counter = field(default_factory=Counter)
    notes: set[int] = field(default_factory=set)
    terms: set[str] = field(default_factory=set)

    def note(self, t: Trail) -> None:
        self.kinds[t.kind] += 1
        self.domains.update(t.domains)
        self.notes |= t.ends
        self.terms |= set(t.surprise)
        self.shown.add(t.digest)


def pair_digest(*ends: int) -> str:
    """A name for a note or a pair of notes, in either order, that tells neither."""
    return hashlib.sha256("\0".join(map(str, sorted(ends))).encode()).hexdigest()


def remembered(digests: list[str]) -> list[str]:
    """The digests to keep: each once, the latest MOST_FEEDBACK of them in order."""
    latest = list(dict.fromkeys(reversed(digests)))[:MOST_FEEDBACK]
    return latest[::-1]


def pool(notes: DataFrame, structural: DataFrame, scored: DataFrame, held: DataFrame, p95: float) -> DataFrame:
    """The trails that a tour chooses from, stored: (kind, l, r, the parts of a score, surprise, domains, hub, digest, parallel, rank).
    rank orders them, single notes first, then by kind and ids; parallel tells of a pair that is a parallel invention too."""
    lone = structural.select(F.col("note_id").alias("l"), F.col("note_id").alias("r"), "kind", *trails.PARTS, F.array().cast("array<string>").alias("surprise"))
    every = lone.unionByName(scored.select(lone.columns))
    for end in "lr":
        side = notes.select(F.col("note_id").alias(end), trails.domain(F.col("domain")).alias(f"{end}_domain")).join(held.select(F.col("note_id").alias(end), F.col("degree").alias(f"{end}_degree")), end)
        every = every.join(side, end)
    every = every.withColumns({"hub": F.greatest("l_degree", "r_degree") > p95, "domains": F.array_distinct(F.array("l_domain", "r_domain"))})
    return ranked(every.drop("l_domain", "r_domain", "l_degree", "r_degree"))


def ranked(every: DataFrame) -> DataFrame:
    """Trails (kind, l, r, parts, surprise, domains, hub) with digest, parallel and rank; stored."""
    lone = F.col("l") == F.col("r")
    ends = F.when(lone, F.col("l").cast("string")).otherwise(F.concat_ws("\0", F.least("l", "r").cast("string"), F.greatest("l", "r").cast("string")))
    place = F.array_position(F.array(*map(F.lit, PLACES)), F.col("kind")).cast("int")
    told = every.withColumns({"digest": F.sha2(ends, 256), "rank": F.struct(F.when(F.col("kind").isin(*STRUCTURAL), place).otherwise(len(PLACES) + 1).alias("group"), "l", "r", place.alias("place"))})
    both = told.filter("kind = 'parallel_invention'").select("digest").distinct().withColumn("parallel", F.lit(True))
    return stored(told.join(both, "digest", "left").withColumn("parallel", F.coalesce("parallel", F.lit(False))), "trails")


def _among(column: Column | str, values) -> Column:
    return F.col(column).isin(list(values)) if values else F.lit(False)


def _score(seen: Feedback) -> Column:
    """A trail's score after what was dismissed, and what a tour has used, floored twice."""
    terms = F.arrays_overlap("surprise", F.array(*map(F.lit, sorted(seen.terms)))) if seen.terms else F.lit(False)
    penalty = F.when(_among("digest", seen.dismissed), DISMISSED).otherwise(0.0) + F.when(terms, REPEATED).otherwise(0.0)
    return trails.total(penalty)


def _open(seen: Feedback) -> Column:
    """Whether a trail may still be chosen. Notes of very many links lead nowhere in particular, but for bridges."""
    full = [d for d, n in seen.domains.items() if n >= PER_DOMAIN]
    crowded = F.arrays_overlap("domains", F.array(*map(F.lit, sorted(full)))) if full else F.lit(False)
    used = _among("digest", seen.shown) | _among("l", seen.notes) | _among("r", seen.notes) | _among("kind", [k for k, n in seen.kinds.items() if n >= PER_KIND])
    return ~used & ~crowded & ~(F.col("hub") & (F.col("kind") != "bridge"))


def chosen(every: DataFrame, feedback: Feedback) -> tuple[list[tuple[Trail, float]], int]:
    """(the trails of a tour with their scores by feedback alone, how many domains it could have met, DOMAINS at most): a bridge or
    island, two early ones, a kind not met yet, a domain not met yet, one that several signals bear; then what is left while it leads
    between notes. Each choice is the first row of a job over the stored pool; what was used is told by a few literals."""
    seen = replace(feedback, shown=set(feedback.shown), kinds=Counter(feedback.kinds), domains=Counter(feedback.domains), notes=set(feedback.notes), terms=set(feedback.terms))
    plain = _score(feedback)
    every = every.withColumn("plain", plain)
    could = every.filter(_open(seen)).select(F.explode("domains").alias("d")).distinct().limit(DOMAINS).count()
    kept_back = every.filter("kind = 'reinforced'").orderBy(F.desc("plain"), "rank").select("digest").first()
    reserved = F.lit(False) if kept_back is None else (F.col("digest") == kept_back["digest"]) & (F.col("kind") != "parallel_invention") & (F.col("l") != F.col("r"))
    out: list[tuple[Trail, float]] = []

    def take(rule: Column, rather: Column | None = None) -> bool:
        taken = [(t.kind, t.l, t.r) for t, _ in out]
        fresh = [~((F.col("kind") == k) & (F.col("l") == l) & (F.col("r") == r)) for k, l, r in taken]
        found = every.filter(rule & _open(seen)).filter(functools.reduce(Column.__and__, fresh, F.lit(True)))
        row = found.orderBy(F.desc(F.lit(False) if rather is None else rather), F.round(_score(seen), 12).desc(), "rank").first()
        if row is None:
            return False
        t = Trail(row["kind"], row["l"], row["r"], {c: row[c] for c in trails.PARTS}, tuple(row["surprise"]), frozenset(row["domains"]), row["hub"])
        out.append((t, row["plain"]))
        seen.note(t)
        return True

    take(_among("kind", OPENING))
    for _ in range(2):
        take(_among("kind", EARLY) & ~F.col("parallel") & ~reserved)
    take(~_among("kind", {t.kind for t, _ in out}) & ~reserved)
    met = [d for d, n in seen.domains.items() if n > 0]
    take(~reserved, F.size(F.array_except("domains", F.array(*map(F.lit, met)).cast("array<string>"))) > 0)
    take(F.col("kind") == "reinforced", reserved)
    while len(out) < LENGTH:
        covered = {d for t, _ in out for d in t.domains}
        wider = F.size(F.array_except("domains", F.array(*map(F.lit, sorted(covered))).cast("array<string>"))) > 0 if could >= DOMAINS > len(covered) else None
        if not take(~_among("kind", STRUCTURAL), wider):
            break
    return out, could


def tour(notes: DataFrame, edges: DataFrame, candidates: DataFrame, as_of: str | None, feedback: Feedback | None = None, hashes_changed: int = 0) -> tuple[list[tuple[Trail, float]], str | None]:
    """(trails with their scores, in order; why there are none, or how the tour falls short). Notes and candidates are those of
    trails.scored, of any number."""
    feedback = feedback or Feedback()
    if notes.limit(LEAST_NOTES).count() < LEAST_NOTES:
        return [], "graph_too_small"
    if candidates.limit(LEAST_CANDIDATES).count() < LEAST_CANDIDATES:
        return [], "not_enough_candidates"
    held, _, p95 = trails.central(notes, edges)
    every = pool(notes, trails.structural(notes, edges, candidates, as_of, hashes_changed), trails.scored(candidates, notes, edges, as_of or "1970-01-01"), held, p95)
    if every.isEmpty():
        return [], "no_surprise_terms"
    out, could = chosen(every, feedback)
    covered = {d for t, _ in out for d in t.domains}
    if not out or out[0][0].kind not in OPENING or could >= DOMAINS > len(covered):
        return [], "insufficient_eligible_trails"
    return out, "insufficient_eligible_trails" if len(out) < LEAST_TRAILS else None


def markdown(saved: list[Trail], titles: dict[int, str]) -> str:
    """Saved trails as a list; candidates are marked as such."""
    told = ["# Saved trails", ""]
    for t in saved:
        ends = " - ".join(titles.get(i, str(i)) for i in dict.fromkeys((t.l, t.r)))
        told.append(f"- {t.kind.replace('_', ' ')}: {ends}" + (f" (candidate only; {', '.join(t.surprise)})" if t.kind not in STRUCTURAL else ""))
    return "\n".join(told) + "\n"
