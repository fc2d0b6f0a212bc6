"""The note engine: queries against DuckDB, and cases of Markdown, ranking and change data by hand."""

import glob
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corkboard.functions.text import fence, inline_tags, markdown_links, name_key, path_key, tokens, wikilinks
from corkboard.operators import changes, graph, search
from corkboard.plans import queries as engine

SF = "/root/testdata/sf0.001"
NAMES = sorted(engine.oracle_sql())


def rows(frame):
    def one(v):  # whole numbers beside nulls are floats on one side
        return None if v is None or v is pd.NA or v != v else round(float(v), 6) if isinstance(v, (int, float)) else str(v)

    columns = sorted(frame.columns)
    return columns, sorted(repr([one(v if not hasattr(v, "item") else v.item()) for v in r]) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, name):
    db = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    assert rows(engine.queries()[name](spark, SF).toPandas()) == rows(db.sql(engine.oracle_sql()[name]).df())


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "x string").select(column(F.col("x"))).first()[0]


def test_text(spark):
    assert value(spark, tokens, "The Alpha's beta-2 1234 deadbeef99 ab x’y the") == ["alpha's", "beta-2", "x'y"]
    assert value(spark, wikilinks, "see [[ Target |x]] ![[img]] `[[code]]` [[A#h]]") == ["Target", "A"]
    assert value(spark, markdown_links, "[a](b%20c.md) [u](http://x.md) [i](p.png) [n](plain)") == ["b%20c.md", "plain"]
    assert value(spark, inline_tags, "#valid #include #abc123 a#no [x](#not)") == ["valid"]
    assert value(spark, name_key, "Dir/My Note.md") == "my note"
    assert value(spark, path_key, "Road%20Map.md#part") == "road map"
    assert value(spark, fence, "a ```` b") == "`````"
    keys = {"Two%20B": "two b", "a/../b.md": "b", "../../x.md": "../../x", "k/../../c/Up": "../c/up", "/root/./a//b.MD#part": "root/a/b", "..": "..", ".": ".", "a/..": ".", "bad%zz/..x": "bad%zz/..x"}
    assert {t: value(spark, path_key, t) for t in keys} == keys


def notes(spark, items):
    return spark.createDataFrame([(i, p, p.rsplit("/", 1)[-1][:-3], "d", t) for i, (p, t) in enumerate(items)], "note_id long, path string, title string, domain string, text string")


def test_links(spark):
    n = notes(spark, [("A.md", "[[b]] and [[B]]\r\n[[nowhere]]\r[x](../out.md)"), ("s/B.md", "[a](../A.md) [n](A.md) [[Dup]] [[Two%20B]] [[k/../t/Dup]]"), ("t/Dup.md", "[[./Dup]] [u](x/../../s/B)"), ("u/Dup.md", "[[Dup]] [p](u/Dup.md)"), ("u/u/Dup.md", ""), ("u/Two B.md", "[q](u/Dup.md)")])
    assert {(r.source_id, r.target_id, r.kind, r.line) for r in graph.edges(n).collect()} == {(0, 1, "wikilink", 1), (1, 0, "markdown_link", 1), (1, 5, "wikilink", 1), (1, 2, "wikilink", 1)}
    found = {(r.note_id, r.line, r.target, r.reason) for r in graph.unresolved(n).collect()}
    outside, several = "path_outside_vault", "ambiguous_path"
    assert found == {(0, 2, "nowhere", "not_found"), (0, 3, "../out.md", outside), (1, 1, "../A.md", outside), (1, 1, "Dup", "ambiguous"), (2, 1, "x/../../s/B", outside), (3, 1, "Dup", "ambiguous"), (3, 1, "u/Dup.md", several), (5, 1, "u/Dup.md", several)}


def test_links_by_the_rules(spark):
    """Aliases are names; names without Latin letters are none; fences and frontmatter have no links, but tags."""
    front = "---\naliases: [Decision Log, '中文']\ntags: [One, two]\n---\n"
    n = notes(spark, [("A.md", front + "# A\n[[Beta]] #three\n```\n[[Beta]] #no\n```\n[x](B.md)"), ("B.md", "[[decision log]] [[中文]] [[日本]]\n~~~\n[[A]]"), ("c/日本.md", "[[Beta]]"), ("d/Beta.md", "---\nopen: 1\n[[A]]")])
    assert {(r.source_id, r.target_id, r.kind, r.line, r.place) for r in graph.edges(n).collect()} == {(0, 3, "wikilink", 6, 0), (0, 1, "markdown_link", 10, 0), (1, 0, "wikilink", 1, 0), (2, 3, "wikilink", 1, 0), (3, 0, "wikilink", 3, 0)}
    assert {(r.note_id, r.target, r.reason) for r in graph.unresolved(n).collect()} == {(1, "中文", "not_found"), (1, "日本", "not_found")}
    assert {(r.note_id, r.tag) for r in graph.note_tags(n).collect()} == {(0, "one"), (0, "two"), (0, "three")}
    assert {(r.line, r.place) for r in graph.links(n).filter("note_id = 0 AND kind = 'tag'").collect()} == {(3, 0), (3, 1), (6, 1)}
    assert graph.resolve_note(n, "Decision log") == 0
    for none in ("中文", "日本", ""):
        with pytest.raises(ValueError):
            graph.resolve_note(n, none)


def test_first_path_by_rank(spark, monkeypatch):
    """Of two paths of two steps, that over verified edges comes first, whatever the ids; edges beyond the cap aren't taken."""
    verified = spark.createDataFrame([(1, 5, "wikilink", 1, 0), (5, 9, "wikilink", 1, 0)], "source_id long, target_id long, kind string, line int, place int")
    edges = graph.all_edges(verified, spark.createDataFrame([(1, 3, 0.2), (3, 9, 0.2)], "l long, r long, score double"))
    assert sorted((r.step, r.to_id) for r in graph.path_between(edges, 1, 9).collect()) == [(1, 5), (2, 9)]
    monkeypatch.setattr(graph, "NEIGHBOURS", 1)
    assert [(r.found, r.search_truncated) for r in graph.path_between(edges, 3, 9).collect()] == [(False, True)]


def test_edges_in_order(spark):
    """By note, line and place, not by target or kind."""
    n = notes(spark, [("A.md", "[z](Z.md) [[Z]]\n[[B]]"), ("B.md", "[[A]]"), ("Z.md", "")])
    first = graph.incident(graph.all_edges(graph.edges(n)), n.filter("note_id = 0"), 3, n).orderBy(*graph.edge_order()).collect()
    assert [(r.source_id, r.target_id, r.kind, r.total, r.target_path) for r in first] == [(0, 2, "wikilink", 4, "Z.md"), (0, 2, "markdown_link", 4, "Z.md"), (0, 1, "wikilink", 4, "B.md")]


def test_headings_are_searched(spark):
    s = spark.createDataFrame([(0, 0, "alpha beta", "gamma")], "section_id long, note_id long, heading string, text string")
    n = notes(spark, [("A.md", "gamma")]).withColumns({"relative_path": F.col("path"), "status": F.lit(None).cast("string")})
    assert [r.matched_terms for r in search.search(search.Tables(s, n), "alpha gamma", 3).collect()] == ["alpha gamma"]


def test_packet(spark):
    """The passage at the budget's end is cut to an ellipsis and counts as long as it then is."""
    texts = ["alpha alpha alpha " + "x" * 82, "alpha alpha " + "y" * 70 + "        z", "alpha " + "w" * 100]
    n = notes(spark, [(f"{i}.md", t) for i, t in enumerate(texts)]).withColumns({"relative_path": F.col("path"), "status": F.lit(None).cast("string")})
    s = n.select(F.col("note_id").alias("section_id"), "note_id", "text")
    held = search.Tables(s, n)
    found = search.packet(held, "alpha", 3, 185).orderBy("rank").collect()
    assert [(r.truncated, r.passage) for r in found] == [(False, texts[0]), (True, "alpha alpha " + "y" * 70 + "…")]
    assert search.packet(held, "the", 3, 185).count() == 0 and search.search(held, "", 3).count() == 0
    assert [r.passage for r in search.packet(held, "alpha", 3, 10).collect()] == ["alpha alp…"]


def test_packet_of_all_postings(spark):
    """A section whose terms come late among all postings is scored by all of them."""
    texts = ["alpha alpha"] * 2000 + ["alpha beta"]
    n = notes(spark, [(f"{i}.md", t) for i, t in enumerate(texts)]).withColumns({"relative_path": F.col("path"), "status": F.lit(None).cast("string")})
    held = search.Tables(n.select(F.col("note_id").alias("section_id"), "note_id", "text"), n)
    assert [r.note_id for r in search.packet(held, "alpha beta", 1, 100, whole=True).collect()] == [2000]
    assert [r.place for r in search.Ranking(held, "alpha").best(2, whole=True)] == [(-2, 0, "alpha"), (-2, 1, "alpha")]
    assert [r.note_id for r in search.packet(held, "alpha beta", 1, 100).collect()] == [0]


def test_look_ups(spark):
    n = notes(spark, [("a/One.md", "[[Two]]"), ("b/Two.md", "[[Three]]"), ("c/Three.md", ""), ("d/three.md", ""), ("e/Alone.md", "")])
    assert graph.resolve_note(n, "A/one.md") == 0 and graph.resolve_note(n, "two") == 1
    for missing in ("x/One.md", "Four", "Three"):
        with pytest.raises(ValueError):
            graph.resolve_note(n, missing)
    edges = graph.all_edges(graph.edges(n), spark.createDataFrame([(1, 2, 0.5)], "l long, r long, score double"))
    steps = sorted((r.step, r.from_id, r.to_id, r.kind, r.verified, r.found) for r in graph.path_between(edges, 0, 2).collect())
    assert steps == [(1, 0, 1, "wikilink", True, True), (2, 1, 2, "candidate", False, True)]
    for none in (graph.path_between(edges, 0, 4), graph.path_between(edges, 0, 2, 1), graph.path_between(edges, 0, 0)):
        assert [(r.step, r.found, r.search_truncated) for r in none.collect()] == [(None, False, False)]
    first = graph.incident(edges, spark.createDataFrame([(1,)], "note_id long"), 1).collect()
    assert [(r.source_id, r.is_verified, r.total, r.truncated) for r in first] == [(0, True, 2, True)]


def test_search_refuses(spark):
    with pytest.raises(ValueError):
        search.search(None, "alpha", 0)


def test_changes(spark):
    frame = lambda items: spark.createDataFrame(items, "path string, content_hash string")
    d = changes.diff(frame([("a", "1"), ("b", "2"), ("c", "3")]), frame([("a", "1"), ("b", "9"), ("d", "3")]))
    assert {(r.path, r.change) for r in d.collect()} == {("b", "modified"), ("c", "removed"), ("d", "added")}
    assert [(r.old_path, r.new_path) for r in changes.renames(d).collect()] == [("c", "d")]


def test_path(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "source_id long, target_id long")
    assert {(r.note_id, r.hops) for r in graph.reached(e, 1, 2).collect()} == {(1, 0), (2, 1), (3, 2)}


def test_without_the_subpackage():
    import __spark_entry__

    assert "search_topk" in __spark_entry__.queries()
