"""Kinds of trails, by hand-made graphs."""

import random

import duckdb
import pytest

from corkboard.operators import graph, trails
from corkboard.plans import queries as engine
from corkboard.plans import trail_queries

NOTES = "note_id long, title string, path string, tags array<string>, domain string, created_at string, modified_at string"


def test_kinds_and_drift(spark):
    days = ["2024-01-01", "2024-01-10", "2024-03-01", "2024-01-05", "2024-01-01", None]
    notes = spark.createDataFrame([(i, f"Note{i}", f"n{i}.md", ["tag"], "xy"[i % 2], days[i], "2024-04-01") for i in range(6)], NOTES)
    edges = spark.createDataFrame([(0, 2), (2, 3), (3, 4)], "source_id long, target_id long")
    pairs = spark.createDataFrame([(0, 1, ["aa", "bb", "cc"], [], []), (0, 3, ["aa", "bb"], ["tag"], [2]), (0, 4, ["note0", "aa"], [], []), (1, 4, ["Note1", "aa"], ["tag"], [3]), (2, 5, ["aa", "bb"], [], [])], "l long, r long, terms array<string>, shared_tags array<string>, mutual array<long>")
    assert {(r.l, r.r) for r in trails.linked_within(pairs, edges).collect()} == {(0, 3), (0, 4)}
    crossings = spark.createDataFrame([("x", "y", 2)], "a string, b string, n long")
    got = {(r.l, r.r, r.kind) for r in trails.kinds(pairs, notes, edges, crossings).collect()}
    assert got == {(0, 1, "parallel_invention"), (0, 1, "unwritten_link"), (1, 4, "unwritten_link"), (2, 5, "unwritten_link")}
    rare = {(r.l, r.r, r.kind) for r in trails.kinds(pairs, notes, edges, crossings.filter("n < 2")).collect()}
    assert rare - got == {(0, 1, "distant_neighbors"), (0, 3, "distant_neighbors"), (0, 3, "parallel_invention"), (0, 3, "reinforced"), (1, 4, "distant_neighbors"), (1, 4, "reinforced"), (2, 5, "distant_neighbors")}
    assert {(r.note_id, r.days) for r in trails.drift(notes, pairs).collect()} == {(0, 91), (4, 91)}
    both = spark.createDataFrame([(0, 2), (0, 1), (3, 1)], "source_id long, target_id long")
    assert [r.note_id for r in graph.bridges(both, notes).collect()] == [0]


def test_days_are_counted_whole_and_broken(spark):
    """Fourteen days and a microsecond are beyond fourteen days, whatever the dates."""
    made = ["2024-01-01 00:00:00", "2024-01-14 23:00:00", "2024-01-15 00:00:00", "2024-01-15 00:00:00.000001"]
    notes = spark.createDataFrame([(i, f"Note{i}", f"n{i}.md", [], "x" if i == 0 else f"y{i}", t, "2024-04-01") for i, t in enumerate(made)], NOTES)
    pairs = spark.createDataFrame([(0, i, ["aa", "bb", "cc"], [], []) for i in (1, 2, 3)], "l long, r long, terms array<string>, shared_tags array<string>, mutual array<long>")
    edges = spark.createDataFrame([], "source_id long, target_id long")
    found = trails.kinds(pairs, notes, edges, spark.createDataFrame([], "a string, b string, n long")).filter("kind = 'parallel_invention'")
    assert sorted(r.r for r in found.collect()) == [1, 2]


def test_star(spark):
    """Leaves of a hub are two links apart; no work is done for all pairs of them."""
    hub = spark.range(1, 100_001).selectExpr("CAST(0 AS BIGINT) AS source_id", "id AS target_id").unionByName(spark.createDataFrame([(200_000, 200_001), (200_001, 5)], "source_id long, target_id long"))
    pairs = spark.createDataFrame([(1, 2), (7, 99_999), (0, 3), (1, 200_001), (1, 200_000), (5, 200_000), (300_000, 1), (4, 4)], "l long, r long")
    assert {(r.l, r.r) for r in trails.linked_within(pairs, hub).collect()} == {(1, 2), (7, 99_999), (0, 3), (1, 200_001), (5, 200_000), (4, 4)}


@pytest.fixture(scope="module")
def crowded(tmp_path_factory):
    """Documents that share frequent words alone, so that the best partners stand far apart in the words' lists; with a way to ask
    DuckDB of them."""
    path, db, rng = tmp_path_factory.mktemp("crowded"), duckdb.connect(), random.Random(4)
    texts = ", ".join(f"({i}, '{' '.join(f'w{k}x' for k in rng.sample(range(48), 6))}', '{rng.choice(['en', 'de'])}', 'src{i % 3}', 30)" for i in range(240))
    db.sql(f"CREATE TABLE documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text, lang, source, n_chars FROM (VALUES {texts}) t(doc_id, text, lang, source, n_chars)")
    db.sql("CREATE TABLE labels AS SELECT doc_id, doc_id % 2 AS quality, 0 AS toxic FROM documents WHERE doc_id % 3 = 0")
    for t in ("documents", "labels"):
        db.sql(f"COPY {t} TO '{path}/{t}.parquet'")
    return str(path), lambda sql: set(db.sql(sql).fetchall())


def test_scores_of_all_pairs(spark, crowded):
    """Pairs that are far apart in their terms' lists are scored too."""
    path, ask = crowded
    got = {tuple(r) for r in engine.queries()["trail_scores"](spark, path).collect()}
    want = ask(engine.oracle_sql()["trail_scores"])
    assert {r[:3] for r in got} == {r[:3] for r in want} and sum(r[4] for r in got) == pytest.approx(sum(r[4] for r in want))
    assert {r[:2] for r in got} - {r[:2] for r in ask(engine.oracle_sql()["discovery_candidates"])}


def test_tour_of_all_pairs(spark, crowded, monkeypatch):
    """A tour chooses among the candidates of all pairs."""
    path, ask = crowded
    met = []
    monkeypatch.setattr(trail_queries.tour, "tour", lambda notes, edges, candidates, as_of: met.extend(candidates.select("l", "r").collect()) or ([], None))
    engine.queries()["trail_tour"](spark, path).collect()
    want = ask(f"WITH {engine._WHOLE_CANDIDATES} SELECT l, r FROM cand")
    assert {tuple(r) for r in met} == want and want - {r[:2] for r in ask(engine.oracle_sql()["discovery_candidates"])}
