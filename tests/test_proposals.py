"""Edits after renames to the byte, proposals, scans, gates, registries, derived links and task contracts, by hand."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from corkboard.functions.storage import shared_path
from corkboard.operators import changes, contract, gate, graph, proposals, sections, task
from corkboard.operators.index import build
from corkboard.sources import registry


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


BEFORE = {
    "Old.md": "target", "s/Crlf.md": "a\r\n[[Old|x]] ![[Old]] $1\\E\r\nend\r\n", "Bom.md": "﻿top\n[l](Old.md#part \"t\") [m](Old.md)", "s/Two.md": "[[old]] and\r[[Old]]", "s/Rel.md": "[r](../Old.md) [[Old]]",
    "Md.md": "x [l](Old.md#part)\n", "Alias.md": "[[Other Name]]", "Drift.md": "[[Old]]", "Plain.md": "see [[ Old ]]", "q/New.md": "same stem",
}


def vault(spark, items):
    return spark.createDataFrame([(i, p, p.rsplit("/", 1)[-1][:-3], t) for i, (p, t) in enumerate(items.items())], "note_id long, path string, title string, text string")


def test_rename_edits(spark):
    """CRLF, CR, a byte order mark, embeds and regex characters stay as they are; a second link to the old note stops the edit."""
    index = vault(spark, BEFORE | {"Old.md": "---\naliases: Other Name\n---\ntarget"}).withColumn("content_hash", F.sha2("text", 256))
    now = dict(BEFORE) | {"Drift.md": "changed"}
    files = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in now.items() if p != "Old.md"], "path string, content binary")
    renamed = spark.createDataFrame([("Old.md", "r/New.md", 1), ("Alias.md", "x.md", 2)], "old_path string, new_path string, candidates long")
    found = {(r.referrer, r.kind): r for r in proposals.rename_edits(renamed, graph.edges(index), index, files).collect()}
    reasons = {k: r.reason for k, r in found.items()}
    several = "multiple_occurrences_manual_review"
    assert reasons == {
        ("s/Crlf.md", "wikilink"): None, ("Bom.md", "markdown_link"): several, ("s/Two.md", "wikilink"): several, ("s/Rel.md", "wikilink"): several, ("Md.md", "markdown_link"): None,
        ("Alias.md", "wikilink"): several, ("Drift.md", "wikilink"): "content_hash_drift", ("Plain.md", "wikilink"): None,
    }
    crlf, md, plain = found["s/Crlf.md", "wikilink"], found["Md.md", "markdown_link"], found["Plain.md", "wikilink"]
    # another note is named New, so a bare name would mean two
    assert (crlf.old_text, crlf.replacement_text) == ("[[Old|x]]", "[[r/New|x]]") and crlf.predicted_hash == sha("a\r\n[[r/New|x]] ![[Old]] $1\\E\r\nend\r\n")
    assert (md.old_text, md.replacement_text, md.predicted_hash) == ("[l](Old.md#part)", "[l](r/New.md#part)", sha("x [l](r/New.md#part)\n"))
    assert plain.replacement_text == "[[r/New]]" and plain.precondition_hash == sha(BEFORE["Plain.md"])
    alone = proposals.rename_edits(renamed, graph.edges(index), index.filter("path <> 'q/New.md'"), files).filter("referrer = 'Plain.md'").first()
    assert alone.replacement_text == "[[New]]"


def test_byte_order_mark(spark):
    index = vault(spark, {"Old.md": "", "Bom.md": "﻿[[Old]]\n"}).withColumn("content_hash", F.sha2("text", 256))
    files = spark.createDataFrame([("Bom.md", bytearray("﻿[[Old]]\n".encode())), ("Bad.md", bytearray(b"\xff"))], "path string, content binary")
    renamed = spark.createDataFrame([("Old.md", "a.b.md", 1)], "old_path string, new_path string, candidates long")
    edges = spark.createDataFrame([(1, 0, "wikilink", 1, "Old")], "source_id long, target_id long, kind string, line int, target_text string")
    r = proposals.rename_edits(renamed, edges, index, files).first()
    assert (r.reason, r.replacement_text, r.predicted_hash) == (None, "[[a.b]]", sha("﻿[[a.b]]\n"))


def test_proposals_need_grounds(spark):
    """What nothing refers to gets none; ids are of what they rest on."""
    frame = spark.createDataFrame
    assessed = frame([("gone.md", "DELETED"), ("lone.md", "DELETED"), ("moved.md", "DELETED")], "path string, relation string")
    edits = frame([("moved.md", "to.md", "a.md", None, "h1", "h2"), ("moved.md", "to.md", "b.md", "content_hash_drift", "h3", None)], "old_path string, new_path string, referrer string, reason string, precondition_hash string, predicted_hash string")
    inbound = frame([("gone.md", "a.md"), ("gone.md", "b.md"), ("moved.md", "a.md"), ("kept.md", "a.md")], "path string, other_path string")
    broken = frame([("x.md", "x.md:1-2", "range_mismatch"), ("y.md", "y.md:1-1", "unreadable")], "path string, citation string, reason string")
    members = frame([("h", "c1.md", True), ("h", "c2.md", False), ("h", "c3.md", True)], "content_hash string, path string, changed boolean")

    def told(broken):
        return {(r.action, r.path): r for r in proposals.proposals("vault", assessed, edits, inbound, broken, members).collect()}

    found = told(broken)
    assert {k: (r.edits, r.grounds) for k, r in found.items()} == {
        ("fix_links_after_rename", "moved.md"): (1, 1), ("review_dangling_references", "gone.md"): (0, 2), ("review_broken_citations", "x.md"): (0, 1),
        ("review_duplicates", "c1.md"): (0, 2), ("review_duplicates", "c3.md"): (0, 2),
    }
    other = told(frame([("x.md", "x.md:1-3", "range_mismatch")], "path string, citation string, reason string"))
    assert len({r.proposal_id for r in found.values()}) == 5 and other["review_broken_citations", "x.md"].proposal_id != found["review_broken_citations", "x.md"].proposal_id
    assert other["review_duplicates", "c1.md"].proposal_id == found["review_duplicates", "c1.md"].proposal_id


def test_broken_in(spark):
    changed = spark.createDataFrame([("a", "modified", sha("1\nx\n3"), "i"), ("b", "removed", None, "i"), ("c", "modified", sha(b"\xff"), "i"), ("d", "modified", "other", "i"), ("e", "modified", "i", "i")], "path string, change string, new_hash string, index_hash string")
    held = spark.createDataFrame([(p, s, e, t) for p in "abcde" for s, e, t in ((1, 1, "1"), (1, 2, "1\n2"), (3, 9, "3"))], "path string, line_start int, line_end int, text string")
    files = spark.createDataFrame([(p, bytearray(t)) for p, t in (("a", b"1\nx\n3"), ("c", b"\xff"), ("d", b"z"), ("e", b"z"))], "path string, content binary")
    found = sorted((r.citation, r.reason) for r in proposals.broken_in(changed, held, files).collect())
    assert found == [("a:1-2", "range_mismatch"), ("a:3-9", "range_mismatch"), *[(f"b:{x}", "note_deleted") for x in ("1-1", "1-2", "3-9")], *[(f"c:{x}", "unreadable") for x in ("1-1", "1-2", "3-9")]]


def test_no_false_removals(spark):
    before = spark.createDataFrame([(p, "1") for p in ("top", "a/x", "a/b/y", "a/b2/z", "torn", "out", "gone", "same")], "path string, content_hash string")
    seen = spark.createDataFrame([("torn", None), ("new-torn", None), ("same", "1"), ("same", "1"), ("new", "2"), ("out", "3")], "path string, content_hash string")
    failed, out = spark.createDataFrame([("a/b",), ("a/b",)], "path string"), spark.createDataFrame([("out",)], "path string")
    found, after = changes.observed(before, seen, failed, out)
    assert {(r.path, r.change) for r in found.collect()} == {("top", "removed"), ("a/x", "removed"), ("a/b2/z", "removed"), ("gone", "removed"), ("new", "added")}
    assert {(r.path, r.content_hash) for r in after.collect()} == {("a/b/y", "1"), ("torn", "1"), ("same", "1"), ("new", "2")}
    whole, kept = changes.observed(before, seen.limit(0), spark.createDataFrame([("",)], "path string"), out.limit(0))
    assert whole.count() == 0 and kept.count() == before.count()


def test_gate(spark):
    def parts(heads, secs):
        return {"heading": spark.createDataFrame(heads, "path string, ordinal int, line int, level int, text string"), "section": spark.createDataFrame(secs, "path string, ordinal int, heading string, line_start int, line_end int")}

    before = parts([("f", 0, 1, 1, "A"), ("f", 1, 4, 2, "B"), ("p", 0, 1, 1, "A")], [("f", 0, "A", 2, 3), ("p", 0, "A", 2, 3)])
    after = parts([("f", 0, 1, 1, "A"), ("p", 0, 1, 1, "A"), ("p", 1, 9, 1, "Z"), ("n", 0, 1, 1, "N")], [("f", 0, "A", 2, 4), ("p", 0, "A", 2, 8), ("p", 1, "Z", 10, 10), ("n", 0, "N", 2, 2)])
    edits = spark.createDataFrame([("f", "fix_unresolved_link"), ("p", "append_at_eof"), ("n", "fix_unresolved_link"), ("p", "create_new_file")], "path string, mutation_class string")
    assert {(r.path, r.part, r.ordinal, r.reason) for r in gate.structure(edits, before, after).collect()} == {("f", "heading", 1, "lost"), ("f", "section", 0, "changed")}
    row = lambda *v: spark.createDataFrame([v], "notes long, unresolved_links long, verified_edges long")
    found = {r.counter: (r.delta, r.low, r.high, r.within) for r in gate.receipts(edits.filter("path <> 'n'"), row(5, 3, 2), row(7, 2, 3)).collect()}
    assert found == {"notes": (2, 0, 1, False), "unresolved_links": (-1, -1, 0, True), "verified_edges": (1, 0, 1, True)}
    gone = gate.missing_targets(edits, spark.createDataFrame([("p",)], "path string"))
    assert {r.path for r in gone.collect()} == {"f", "n"}


def test_registry(spark):
    def entry(position, name="s", type="folder", root="/a", mode="read_only", found="folder", include=()):
        return ("r", position, name, type, root, mode, list(include), found)

    rows = [
        entry(1, "one", root="/v/a"), entry(2, "two", root="/v/ab"), entry(3, "three", root="/v/a/b/c"), entry(4, "four", root="/v/a"), entry(5, "One", root="/w"), entry(6, "six", "file", "/x/n.md", found="file"),
        entry(7, "seven", root="/y", mode="appliable"), entry(8, "eight", "file", "/z", "appliable", "file", ["a"]), entry(9, None), entry(10, "ten", root="rel"), entry(11, "x", root="/q", found=None), entry(12, "two", root="/t"),
        entry(13, "y", root="/v/a", found="file"), entry(14, "z://", root="/u"),
    ]
    schema = "registry string, position int, name string, type string, root string, mode string, include_paths array<string>, found string"
    found = {r.position: (r.reason, r.overlaps, r.overlaps_with) for r in registry.judged(spark.createDataFrame(rows, schema)).collect()}
    over = "overlapping_root"
    assert found == {
        1: (over, 2, "three"), 2: (None, 0, None), 3: (over, 2, "one"), 4: (over, 2, "one"), 5: ("name_collision", 0, None), 6: (None, 0, None), 7: ("no_allowlist", 0, None), 8: ("appliable_file", 0, None),
        9: ("missing_key", 0, None), 10: ("relative_root", 0, None), 11: ("root_missing", 0, None), 12: ("duplicate_name", 0, None), 13: ("root_not_folder", 0, None), 14: ("remote", 0, None),
    }
    whole = spark.createDataFrame([entry(1, "a", root="/"), entry(2, "b", root="/k/../m/")], schema)
    assert [r.overlaps for r in registry.judged(whole).collect()] == [1, 1]


NOTES = {"A.md": "# A\nsee [[B]] here\n```\n[[C]]\n```\n## to [[C]]\n", "B.md": "# B\nreport [c](C.md)\n", "C.md": "# C\nsome words\n", "d/X.md": "# X\nx\n", "e/X.md": "# X\ny [[X]]\n"}


def held(spark):
    df = vault(spark, NOTES)
    own = sections.sections(df).withColumn("section_id", F.col("note_id") * 16 + F.col("ordinal"))
    return df, build(spark, shared_path(spark, "index"), df, own)


def test_derived_links(spark):
    df, index = held(spark)
    claims = [
        (0, 1, "wikilink", True, 1.0, 2, "see [[B]] here", "B", None), (0, 2, "wikilink", True, 1.0, 6, "## to [[C]]", "C", None), (1, 2, "markdown_link", True, 1.0, 2, "report [c](C.md)", "C.md", None),
        (0, 2, "wikilink", True, 1.0, 4, "[[C]]", "C", "no_link"), (0, 2, "wikilink", True, 1.0, 2, "see [[B]] here", "B", "other_target"), (0, 1, "wikilink", True, 1.0, 6, "see [[B]] here", "B", "no_link"),
        (0, 1, "markdown_link", True, 1.0, 2, "see [[B]] here", "B", "no_link"), (4, 3, "wikilink", True, 1.0, 2, "y [[X]]", "X", "other_target"), (0, 0, "wikilink", True, 1.0, 2, "see [[B]] here", "B", "self_link"),
        (0, 1, "wikilink", True, 0.9, 2, "see [[B]] here", "B", "score"), (0, 1, "wikilink", True, 1.0, 99, "see [[B]] here", "B", "no_link"), (0, 1, "mention", True, 1.0, 2, "see [[B]] here", "B", "unknown_kind"),
        (0, 3, "candidate", False, 0.4, None, None, None, None), (0, 3, "candidate", False, 0.0, None, None, None, "score"), (0, 1, "wikilink", True, 1.0, None, None, None, "no_link"),
    ]
    frame = spark.createDataFrame(claims, "source_id long, target_id long, kind string, is_verified boolean, score double, line int, source_text string, target_text string, want string")
    found = contract.authored_links_hold(frame, index.sections(), sections.headings(df), index.notes(), index.names(), graph.paths(index.notes())).collect()
    assert len(found) == len(claims) and [(r.want, r.reason) for r in found if r.want != r.reason] == []


def test_task(spark):
    """Hits that are excluded are counted, not emitted; a passage is cut at the budget's end; named notes must not be excluded, and
    what the index doesn't bear out is refused."""
    df, index = held(spark)
    edges = graph.all_edges(index.edges())
    spec = {"objective": "o", "retrieval": {"query": "words see report", "limit": 2, "max_characters": 50}, "constraints": [{"note": "c"}], "exclusions": {"paths": ["b.md"]}}
    found = task.build(index, task.read_task(json.dumps(spec)), edges)
    items = sorted((r.section, r.place, r.note_id, r.other_id, r.characters, r.truncated, r.text) for r in found.items.collect())
    assert items == [
        ("connection", 1, 0, 2, 0, False, "wikilink"), ("constraint", 0, 2, None, 10, False, "some words"), ("constraint_passage", 0, 2, None, 10, False, "some words"), ("objective", 0, None, None, 1, False, "o"),
        ("retrieved_context", 1, 0, None, 28, False, "see [[B]] here\n```\n[[C]]\n```"),
    ]
    t = found.totals.first()
    assert (t.character_budget, t.characters_used, t.truncated, t.suppressed_context, t.suppressed_connections, t.suppressed_notes) == (50, 49, True, 1, 1, 1)
    assert (t.profile, t.includes_passage_text, t.includes_paths_titles_tags, t.includes_candidate_edges) == ("task_scoped_bounded_passages", True, True, False)
    task.check_edges(index, found, sections.headings(df))
    with pytest.raises(ValueError, match="borne out"):
        task.check_edges(index, found, sections.headings(df).limit(0))  # the link to C stands in a heading
    for wrong, match in (({"constraints": [{"note": "B"}]}, "excluded"), ({"constraints": [{"note": "X"}]}, "several"), ({"constraints": [{"note": "Nope"}]}, "no note"), ({"constraints": [{"note": "A", "heading": "none"}]}, "heading"), ({"objective": "o" * 61}, "budget")):
        with pytest.raises(ValueError, match=match):
            task.build(index, task.read_task(json.dumps(spec | wrong)), edges)


def test_task_of_all_postings(spark):
    """A hit whose terms come late among all postings is ranked by all of them."""
    df = vault(spark, {f"n{i}.md": "alpha alpha" for i in range(2000)} | {"z.md": "alpha beta"})
    own = sections.sections(df).withColumn("section_id", F.col("note_id") * 16 + F.col("ordinal"))
    index = build(spark, shared_path(spark, "index"), df, own, buckets=2)
    spec = task.read_task('{"objective": "o", "retrieval": {"query": "alpha beta", "limit": 1}, "exclusions": {"paths": ["n0.md"]}}')

    def found(whole):
        told = task.build(index, spec, graph.all_edges(index.edges()), whole=whole)
        return [r.note_id for r in told.items.filter("section = 'retrieved_context'").collect()], told.totals.first().suppressed_context

    assert found(True) == ([2000], 1) and found(False) == ([1], 1)


@pytest.mark.parametrize(
    "spec",
    [
        "[]", '{"objective": 1}', '{"objective": ""}', '{"objective": "o", "x": 1}', '{"objective": "o", "objective": "p"}', '{"objective": "o", "retrieval": {}}', '{"objective": "o", "retrieval": {"query": "q", "limit": true}}',
        '{"objective": "o", "retrieval": {"query": "q", "limit": 51}}', '{"objective": "o", "constraints": [{"text": "a", "note": "b"}]}', '{"objective": "o", "constraints": [{"text": null}]}', '{"objective": "o", "constraints": [{"text": "a", "statement": "b"}]}',
        '{"objective": "o", "task_id": "a b"}', '{"objective": "o", "spec_version": "9"}', '{"objective": "o", "exclusions": {"files": []}}', '{"objective": "o", "acceptance_criteria": [""]}',
    ],
)
def test_strict_specifications(spec):
    with pytest.raises(ValueError):
        task.read_task(spec)


def test_specification():
    told = task.read_task('{"objective": "o", "retrieval": {"query": "q"}, "constraints": [{"note": "n", "heading": null}], "exclusions": {"tags": ["t"]}}')
    assert (told.limit, told.max_characters, told.constraints, told.tags) == (8, 8000, (task.Ref(note="n"),), ("t",))


def test_task_totals_without_hits(spark, tmp_path):
    """As the SQL has it where the first 200 hits are all excluded: no hit is left, and so no answer whether one was cut."""
    import glob
    import os

    import duckdb

    from corkboard.plans import queries as engine

    db = duckdb.connect()
    for f in glob.glob("/root/testdata/sf0.001/*.parquet"):
        name = os.path.basename(f)[:-8]
        text = f"SELECT * FROM '{f}'"
        if name == "supplier":  # those of seven's multiples rank first
            text = f"SELECT * FROM '{f}' WHERE s_suppkey NOT IN (0, 7) UNION ALL SELECT k * 70, 'Supplier#' || lpad(CAST(k * 70 AS VARCHAR), 9, '0'), k % 25, 0.0 FROM range(1, 260) t(k)"
        db.sql(f"COPY ({text}) TO '{tmp_path}/{name}.parquet'")
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    want = db.sql(engine.oracle_sql()["task_totals"])
    want = dict(zip(want.columns, want.fetchall()[0]))
    got = engine.queries()["task_totals"](spark, str(tmp_path)).first().asDict()
    assert want["truncated"] is None and want["suppressed_context"] == 200 and got == want
