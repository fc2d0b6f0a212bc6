"""Exclusions, claims, bounds and assessed changes, by hand."""

import json

import pytest
from pyspark.sql import functions as F

from corkboard.functions.text import collapsed, json_length, passage
from corkboard.operators import changes, contract, discovery, graph


def test_text(spark):
    texts = ["plain", 'quo"te\\', "tab\tline\n\r\x01", "é–​", "😀 smile", "", "\x7f"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.n for r in df.select("t", json_length(F.col("t")).alias("n")).collect()} == {t: len(json.dumps(t)) for t in texts}
    long = spark.createDataFrame([("x" * 498 + "   y", " a \t b​\n")], "t string, s string").select(passage(F.col("t")).alias("t"), collapsed(F.col("s")).alias("s")).first()
    assert long.t == "x" * 498 + "…" and long.s == "a b"


def test_citations(spark):
    texts = {"a/b.md:1-2": True, "a:b/c.md:1-1": False, "d/a:b.md:3-4": True, "/a.md:1-2": False, "a/../b.md:1-2": False, "a.md:0-2": False, "a.md:3-2": False, "a.md": False, "a\\b.md:1-2": False, "a//b.md:1-2": False, None: False}
    claims = spark.createDataFrame([(t,) for t in texts], "citation string")
    held = spark.createDataFrame([("a/b.md", 1, 2), ("d/a:b.md", 3, 5)], "path string, line_start int, line_end int")
    assert {r.citation: (r.valid, r.found) for r in contract.resolved_citations(claims, held).collect()} == {t: (ok, t == "a/b.md:1-2") for t, ok in texts.items()}


def test_exclusions(spark):
    notes = spark.createDataFrame([(1, "A/One.md"), (2, "a/b/two.md"), (3, "c​.md"), (4, "d.md"), (5, "e[1].md")], "note_id long, path string")
    tags = spark.createDataFrame([(4, "Priv​ate"), (4, "x"), (2, "private")], "note_id long, tag string")
    out = contract.excluded(notes, tags, ["a\\one.MD"], ["a/*.md", "[!a-d].md", "c.md"], ["#private"])
    assert {(r.note_id, r.reason) for r in out.collect()} == {(1, "excluded_path"), (2, "excluded_glob"), (3, "excluded_glob"), (4, "excluded_tag")}
    for bad in ("", "x​"):
        with pytest.raises(ValueError):
            contract.excluded(notes, tags, [bad])
    edges = spark.createDataFrame([(9, 1, "w", True, 1.0), (9, 4, "w", True, 1.0), (5, 9, "w", True, 1.0), (9, 6, "candidate", False, 0.3), (9, 7, "candidate", False, 0.9), (5, 6, "w", True, 1.0)], "source_id long, target_id long, kind string, is_verified boolean, score double")
    seed = spark.createDataFrame([(9,)], "note_id long")
    got = [(r.source_id, r.target_id, r.suppressed, r.dropped) for r in contract.allowed_edges(edges, seed, out, limit=2).collect()]
    assert got == [(5, 9, 2, 2), (9, 7, 2, 2)]
    assert [(r.source_id, r.target_id) for r in contract.allowed_edges(edges, seed, out, candidates=False).collect()] == [(5, 9)]
    assert {r.tag for r in contract.tags_at(edges, seed, tags).collect()} == {"Priv​ate", "x"}


def test_claims_and_bounds(spark):
    terms = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "c"), (1, "a")], "note_id long, term string")
    claims = spark.createDataFrame([(1, 2, ["a"]), (1, 2, ["a", "a"]), (1, 2, ["a", "b"]), (1, 2, []), (3, 2, ["a"])], "source_id long, target_id long, terms array<string>")
    assert sorted((r.source_id, r.terms, r.holds) for r in contract.shared_terms_hold(claims, terms).collect()) == [(1, [], False), (1, ["a"], True), (1, ["a", "a"], True), (1, ["a", "b"], False), (3, ["a"], False)]
    items = spark.createDataFrame([("b",), ("a",), ("c" * 10,), ("d",)], "path string")
    assert [(r.place, r.path, r.total) for r in contract.bounded(items, "path", characters=10).collect()] == [(1, "a", 4), (2, "b", 4)]
    assert [r.path for r in contract.bounded(items, "path", most=1).collect()] == ["a"]
    assert contract.bounded(items, "path", characters=3).count() == 0


def test_levels(spark):
    edits = spark.createDataFrame([(1, "s", "p.md", "append_at_eof", {}), (2, "s", "p.md", "move_to_trash", None), (3, "t", "p.md", "append_at_eof", {"status": ["x, 'Final'"]}), (4, "t", "p.md", "append_at_eof", {"status": [None]}), (5, "t", "Keys/p.md", "append_at_eof", {}), (6, "s", "p.md", None, {})], "i int, source string, path string, mutation_class string, frontmatter map<string,array<string>>")
    got = contract.write_levels(edits, "auto_apply", sources={"t": {"append_at_eof": "report_only"}}, terms=["keys"], frontmatter={"status": ["final"]})
    assert {r.i: (r.level, r.reason) for r in got.collect()} == {1: ("auto_apply", "default"), 2: ("require_approval", "auto_apply_clamped"), 3: ("disabled", "protected:frontmatter:status"), 4: ("report_only", "source_override"), 5: ("disabled", "protected:path_terms"), 6: ("disabled", "unknown_class")}


def test_assessed(spark):
    frame = lambda items: spark.createDataFrame(items, "path string, content_hash string")
    d = changes.diff(frame([("m", "1"), ("n", "1"), ("r", "1"), ("q", "1")]), frame([("m", "2"), ("n", "2"), ("a", "2"), ("c", "5")]))
    index = frame([("m", "1"), ("n", "7"), ("r", "1"), ("c", "5"), ("z", "2")])
    assert {(r.path, r.relation, r.diverged) for r in changes.assessed(d, index).collect()} == {("m", "MODIFIED", False), ("n", "MODIFIED", True), ("r", "DELETED", False), ("q", "never_indexed", False), ("a", "NEW", False), ("c", "index_current", False)}
    assert {r.path: (r.duplicate_of, r.of_total, r.in_batch, r.batch_total) for r in changes.duplicates(d, index, 1).collect()} == {"m": (["z"], 1, ["a"], 2), "n": (["z"], 1, ["a"], 2), "a": (["z"], 1, ["m"], 2)}
    assert changes.duplicates(d.limit(0), index).count() == 0


def test_candidates_refuse(spark):
    with pytest.raises(ValueError):
        discovery.candidates(None, 1.5)


def test_matching(spark):
    notes = spark.createDataFrame([(1, "Alpha", "x/a.md", "d", ["t"]), (2, "Beta", "x/b.md", None, None)], "note_id long, title string, path string, domain string, tags array<string>")
    assert [r.note_id for r in graph.matching(notes, " ALPHA x/").collect()] == [1]
    assert [r.note_id for r in graph.matching(notes, "", "d").collect()] == [1] and graph.matching(notes, "").count() == 2
