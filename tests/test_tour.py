"""Tours of trails, by hand-made and random pools, against a plain loop; and a small graph."""

import random
from collections import Counter
from dataclasses import replace

import pytest

from corkboard.operators import tour, trails

NOTES = "note_id long, title string, path string, tags array<string>, domain string, created_at string, modified_at string"
CANDIDATES = "l long, r long, terms array<string>, shared_tags array<string>, mutual array<long>, passages boolean, cited boolean"


def trail(kind, l, r, domains, novelty=1.0, surprise=("aa", "bb"), hub=False):
    parts = dict.fromkeys(trails.PARTS, 0.0) | {"novelty": novelty}
    return tour.Trail(kind, l, r, parts, surprise, frozenset(domains), hub)


def score(self, t):
    penalty = tour.DISMISSED * (t.digest in self.dismissed) + tour.REPEATED * (not self.terms.isdisjoint(t.surprise))
    p = t.parts
    weighted = 0.3 * p["novelty"] + 0.25 * p["distance"] + 0.25 * p["evidence"] + 0.1 * p["centrality"] + 0.1 * p["structure"] - penalty
    return max(0.0, max(0.0, weighted) + p["age"])

def takes(self, t):
    """Whether a trail may still be chosen. Notes of very many links lead nowhere in particular, but for bridges."""
    fresh = t.digest not in self.shown and self.notes.isdisjoint(t.ends) and not (t.hub and t.kind != "bridge")
    return fresh and self.kinds[t.kind] < tour.PER_KIND and all(self.domains[d] < tour.PER_DOMAIN for d in t.domains)


def by_loop(trails_, feedback):
    """What a tour chooses, by a plain loop over a list in order of rank."""
    seen = replace(feedback, shown=set(feedback.shown), kinds=Counter(feedback.kinds), domains=Counter(feedback.domains), notes=set(feedback.notes), terms=set(feedback.terms))
    out = []
    could = {d for t in trails_ if takes(seen, t) for d in t.domains}
    parallel = {t.digest for t in trails_ if t.kind == "parallel_invention"}
    kept_back = max((t for t in trails_ if t.kind == "reinforced"), key=lambda t: score(feedback, t), default=None)

    def open_to(rule):
        return sorted((t for t in trails_ if t not in out and rule(t) and takes(seen, t)), key=lambda t: -round(score(seen, t), 12))

    def reserved(t):
        return kept_back is not None and t.kind != "parallel_invention" and len(t.ends) == 2 and t.digest == kept_back.digest

    def take(found, rather=lambda t: False):
        if found:
            best = next(filter(rather, found), found[0])
            out.append(best)
            seen.note(best)

    take(open_to(lambda t: t.kind in tour.OPENING))
    for _ in range(2):
        take(open_to(lambda t: t.kind in tour.EARLY and t.digest not in parallel and not reserved(t)))
    met = {t.kind for t in out}
    take(open_to(lambda t: t.kind not in met and not reserved(t)))
    take(open_to(lambda t: not reserved(t)), lambda t: any(seen.domains[d] == 0 for d in t.domains))
    take(open_to(lambda t: t.kind == "reinforced"), reserved)
    while len(out) < tour.LENGTH and (rest := open_to(lambda t: t.kind not in tour.STRUCTURAL)):
        covered = {d for t in out for d in t.domains}
        wider = len(could) >= tour.DOMAINS > len(covered)
        take(rest, lambda t: wider and not t.domains <= covered)
    return out, could


def in_order(pool):
    return sorted(pool, key=lambda t: (tour.PLACES.index(t.kind) if t.kind in tour.STRUCTURAL else len(tour.PLACES), t.l, t.r, tour.PLACES.index(t.kind)))


def frame(spark, pool):
    rows = [(t.kind, t.l, t.r, *[t.parts[c] for c in trails.PARTS], list(t.surprise), sorted(t.domains), t.hub) for t in pool]
    parts = ", ".join(f"{c} double" for c in trails.PARTS)
    return tour.ranked(spark.createDataFrame(rows, f"kind string, l long, r long, {parts}, surprise array<string>, domains array<string>, hub boolean"))


def chosen(spark, pool, feedback):
    out, could = tour.chosen(frame(spark, pool), feedback)
    assert [round(s, 9) for _, s in out] == [round(score(feedback, t), 9) for t, _ in out]
    return [t for t, _ in out], could


def test_order(spark):
    pool = [
        trail("bridge", 1, 1, "x", 0.1, ()), trail("island", 2, 2, "y", 0.9, (), hub=True), trail("dormant", 3, 3, "z", 0.5, ()),
        trail("parallel_invention", 4, 5, "xy", 0.2), trail("unwritten_link", 4, 5, "xy"), trail("unwritten_link", 6, 7, "yz", 0.8, ("cc", "dd")),
        trail("reinforced", 8, 9, "vw", 0.7, ("ee", "ff")), trail("unwritten_link", 8, 9, "vw", 0.7, ("ee", "ff")), trail("unwritten_link", 10, 6, "uv", 0.6, ("gg", "hh")),
        trail("distant_neighbors", 11, 12, "st", 0.4, ("cc", "ii")),
    ]
    out, could = chosen(spark, pool, tour.Feedback())
    # the hub is left out, a parallel pair fills no early place, but may a later one by any of its kinds; note 6 is used once
    assert [(t.kind, t.l) for t in out] == [("bridge", 1), ("unwritten_link", 6), ("distant_neighbors", 11), ("dormant", 3), ("unwritten_link", 4), ("reinforced", 8)]
    assert could == tour.DOMAINS
    shown = tour.Feedback(shown={pool[5].digest}, dismissed={pool[9].digest})
    assert [(t.kind, t.l) for t in chosen(spark, pool, shown)[0]][:3] == [("bridge", 1), ("unwritten_link", 10), ("distant_neighbors", 11)]
    assert score(shown, pool[9]) == pytest.approx(0.0) and not shown.kinds


def test_domains_are_met_twice_at_most(spark):
    pool = [trail("island", 1, 1, "x", surprise=())] + [trail("unwritten_link", i, i + 1, "x", surprise=(f"t{i}", f"u{i}")) for i in range(2, 20, 2)]
    assert [t.l for t in chosen(spark, pool, tour.Feedback())[0]] == [1, 2]


def test_as_by_loop(spark):
    """Random pools, with ties, hubs and feedback: the jobs choose what a loop over the whole list does."""
    rng = random.Random(8)
    for _ in range(6):
        pool = {}
        for _ in range(rng.randint(0, 40)):
            kind = rng.choice(tour.PLACES)
            l, r = sorted(rng.sample(range(24), 2))
            r = l if kind in tour.STRUCTURAL else r
            t = trail(kind, l, r, rng.sample("uvwxyz", 1 if l == r else rng.randint(1, 2)), rng.choice([0.1, 0.4, 0.4, 0.9]), tuple(rng.sample(["a", "b", "c", "d", "e", "f"], 0 if l == r else 2)), rng.random() < 0.1)
            pool[kind, l, r] = t
        pool = in_order(pool.values())
        digests = [t.digest for t in pool]
        feedback = tour.Feedback(shown=set(digests[::7]), dismissed=set(digests[1::5]))
        want, could = by_loop(pool, feedback)
        assert chosen(spark, pool, feedback) == (want, min(len(could), tour.DOMAINS))


def graph_of(spark, n):
    notes = spark.createDataFrame([(i, f"Note{i}", f"n{i}.md", ["tag"], "xyz"[i % 3], "2024-01-01", "2024-02-01") for i in range(n)], NOTES)
    edges = spark.createDataFrame([(0, 1), (0, 2), (2, 3)], "source_id long, target_id long")
    return notes, edges


def test_tour(spark):
    notes, edges = graph_of(spark, 9)
    candidates = spark.createDataFrame([(3, 4, ["aa", "bb", "cc"], [], [], True, True), (5, 7, ["dd", "ee"], [], [], True, True), (6, 8, ["ff", "note6"], [], [], True, True), (1, 8, ["gg", "hh"], [], [], True, False), (2, 7, ["ii", "jj"], [], [], False, True)], CANDIDATES)
    scored = {(r.l, r.r, r.kind): r for r in trails.scored(candidates, notes, edges, "2024-02-01").collect()}
    assert {k[:2] for k in scored} == {(3, 4), (5, 7)}  # one has a term of a label, one isn't cited, one has too little evidence
    assert scored[(3, 4, "unwritten_link")].score == pytest.approx(0.3 + 0.25 + 0.25 * 0.5 + 0.1 * scored[(3, 4, "unwritten_link")].centrality)
    found, remark = tour.tour(notes, edges, candidates, "2024-02-01")
    assert found[0][0].kind == "bridge" and found[0][0].l == 0 and {(t.l, t.r) for t, _ in found[1:]} <= {(3, 4), (5, 7)} | {(i, i) for i in range(9)}
    assert remark in (None, "insufficient_eligible_trails")
    told = tour.markdown([t for t, _ in found], {0: "Zero"})
    assert "- bridge: Zero\n" in told and "candidate only" in told


def test_refusals(spark):
    notes, edges = graph_of(spark, 9)
    none = spark.createDataFrame([], CANDIDATES)
    assert tour.tour(notes.limit(7), edges, none, None) == ([], "graph_too_small")
    assert tour.tour(notes, edges, none, None) == ([], "not_enough_candidates")


def test_feedback():
    assert tour.pair_digest(2, 1) == tour.pair_digest(1, 2) != tour.pair_digest(1)
    assert tour.remembered(["a", "b", "a"]) == ["b", "a"] and len(tour.remembered([str(i) for i in range(900)])) == 500
