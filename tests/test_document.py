"""Graph documents by hand: safe texts, strict times, refusals, claims."""

import json

import pytest
from pyspark.sql import functions as F

from corkboard.functions.text import safe_hash, safe_identifier, safe_label, safe_text, utc_micros
from corkboard.operators import document


def test_strict_times(spark):
    cases = {
        "1970-01-01T00:00:00Z": 0, "1970-01-01T00:00:00.5Z": 500_000, "1970-01-01T01:00:00+01:00": 0, "1969-12-31T23:59:59.000001Z": -999_999, "2024-02-29T12:00:00.123456-05:30": 1_709_227_800_123_456,
        "2023-02-29T00:00:00Z": None, "2024-01-01T24:00:00Z": None, "2024-01-01T00:00:60Z": None, "2024-01-01 00:00:00Z": None, "2024-01-01T00:00:00": None, "2024-01-01T00:00:00.1234567Z": None, "0999-01-01T00:00:00Z": None,
        "1000-01-01T00:00:00+00:01": None, "9999-12-31T23:59:59.999999Z": 253_402_300_799_999_999, "9999-12-31T23:59:59-00:01": None, "2024-01-01T00:00:00+24:00": None, " 2024-01-01T00:00:00Z": None, "": None, "2024-13-01T00:00:00Z": None,
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", utc_micros(F.col("t")).alias("m"))
    assert {r.t: r.m for r in df.collect()} == cases


def test_safe_texts(spark):
    text = "a\x00b​c‮d\te\nf﻿" + "x" * 2000
    row = spark.createDataFrame([(text, "A" * 64, "g" * 64)], "t string, h string, g string").select(safe_text(F.col("t")), safe_label(F.col("t")), safe_identifier(F.col("t")), safe_hash(F.col("h")), safe_hash(F.col("g"))).first()
    assert (row[0][:9], len(row[0]), row[1][:8], row[2][:7], row[3], row[4]) == ("abcd\te\nfx", 1000, "abcd e f", "abcdefx", "a" * 64, None)


def node(i, **more):
    return {"id": i, "title": f"T{i}", "path": f"{i}.md", "tags": ["x"]} | more


HASH = "0" * 64
HISTORY = {"export_id": "e", "previous_content_hash": None, "node_content_hashes_changed": 0, "node_content_hashes_unchanged": 0, "nodes_added": 2, "nodes_removed": 0}


def read(spark, docs):
    rows = [(name, text if isinstance(text, str) else json.dumps(text)) for name, text in docs.items()]
    return document.read(spark.createDataFrame(rows, "document string, text string"))


def test_read(spark):
    v1, v2 = document.VERSIONS
    two = [node("a"), node("b")]
    evidence = {"source_evidence": {"passage": "p"}}
    docs = {
        "first": {"schema_version": v1, "nodes": two, "edges": [{"id": "e", "source": "a", "target": "b"}, {"source": "a", "target": "z"}, {"id": "e", "source": "b", "target": "a"}, {"source": "b", "target": "a"}]},
        "second": {"schema_version": v2, "nodes": [node("a", created_at="2024-01-01T00:00:00Z", content_hash=HASH), node("b", created_at="soon", content_hash="bad")], "edges": [], "export_history": HISTORY, "privacy": {"export_profile": "graph_metadata", "metadata_only": True}},
        "text": {"schema_version": v2, "nodes": two, "edges": [{"source": "a", "target": "b", "evidence": evidence}], "export_history": HISTORY, "privacy": {"includes_passage_text": False}},
        "terms": {"schema_version": v2, "nodes": two, "edges": [{"source": "a", "target": "b", "evidence": {"shared_terms": ["t"]}}], "privacy": {"export_profile": "graph_metadata_and_note_derived_terms"}},
        "sum": {"schema_version": v2, "nodes": two, "edges": [], "export_history": HISTORY | {"nodes_added": 1}}, "later": {"schema_version": v2, "nodes": two, "edges": [], "export_history": HISTORY | {"previous_content_hash": HASH, "nodes_added": 1, "node_content_hashes_changed": 1, "nodes_removed": 5}},
        "malformed": {"schema_version": v2, "nodes": two, "edges": [], "export_history": HISTORY | {"previous_content_hash": "x", "nodes_added": 0, "node_content_hashes_changed": 2}}, "twice": {"schema_version": v2, "nodes": [*two, node("a")], "edges": [], "export_history": HISTORY},
        "empty": {"schema_version": v1, "nodes": [], "edges": []}, "cut": '{"schema_version": "' + v1, "none": "null", "version": {"schema_version": "v0", "nodes": [], "edges": []}, "edgeless": {"schema_version": v1, "nodes": []},
        "nameless": {"schema_version": v1, "nodes": [{"id": "​"}], "edges": []},
    }
    found = read(spark, docs)
    told = {r.document: r for r in found.documents.collect()}
    assert {k: r.refusal for k, r in told.items() if r.refusal} == {"cut": "not_json", "none": "not_json", "version": "unsupported_version", "edgeless": "no_nodes_or_edges", "nameless": "node_without_id"}
    f = told["first"]
    assert (f.n_nodes, f.n_edges, f.duplicate_nodes, f.dangling_edges, f.duplicate_edges, f.export_profile, f.usable) == (2, 2, 0, 1, 1, "graph_metadata", True)
    assert {r.id for r in found.edges.filter("document = 'first'").collect()} == {"e", "edge-4"}
    assert {k: r.export_profile for k, r in told.items() if k in ("text", "terms", "empty")} == {"text": "graph_with_bounded_passage_text", "terms": "graph_metadata_and_note_derived_terms", "empty": "empty_graph"}
    assert {k for k, r in told.items() if r.privacy_conflict} == {"text"}
    assert {k for k, r in told.items() if r.history_conflict} == {"sum", "malformed"}
    assert {k for k, r in told.items() if r.usable} == {"first", "text", "later", "empty"}  # the second has a bad hash, others no sound history
    times = {r.id: (r.created_at, r.content_hash) for r in found.nodes.filter("document = 'second'").collect()}
    assert times == {"a": (1_704_067_200_000_000, HASH), "b": (None, None)}
    assert told["twice"].duplicate_nodes == 1


def test_limits(spark, monkeypatch):
    monkeypatch.setattr(document, "NODES", 2)
    big = {"schema_version": document.VERSIONS[0], "nodes": [node(str(i)) for i in range(3)], "edges": []}
    assert read(spark, {"big": big}).documents.first().refusal == "too_many"
    nodes = spark.createDataFrame([("d", i, str(i)) for i in range(3)], "document string, position long, id string")
    edges = spark.createDataFrame([], "document string, position long, id string")
    heads = spark.createDataFrame([("d",)], "document string").select("document", F.lit("t").alias("title"), F.lit("n").alias("generated_at"), F.lit(None).cast(document.HISTORY).alias("history"))
    with pytest.raises(ValueError, match="more than 2"):
        document.documents(nodes, edges, heads)
    whole = {"big": big | {"nodes": [node("1"), node("2"), node("3")]}}
    texts = spark.createDataFrame([(k, json.dumps(v)) for k, v in whole.items()], "document string, text string")
    assert document.read(texts, limited=False).documents.first().n_nodes == 3


def test_graph_documents_of_many_nodes(spark, monkeypatch):
    """The query's documents hold all that a nation has, whatever a viewer's limits."""
    from corkboard.plans import queries as engine

    sf = "/root/testdata/sf0.001"
    before = engine.queries()["graph_documents"](spark, sf).orderBy("document").collect()
    monkeypatch.setattr(document, "NODES", 2)
    monkeypatch.setattr(document, "EDGES", 2)
    assert engine.queries()["graph_documents"](spark, sf).orderBy("document").collect() == before
