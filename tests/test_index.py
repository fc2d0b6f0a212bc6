"""The stored index: versions, replaced notes, pruned buckets; and discovery over it."""

import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corkboard.functions.storage import shared_path
from corkboard.operators import discovery, graph, index, search
from corkboard.operators.index import build, open_index


def notes(spark, items):
    return spark.createDataFrame([(i, p, p.rsplit("/", 1)[-1][:-3], t) for i, p, t in items], "note_id long, path string, title string, text string")


def sections(df):
    return df.select(F.col("note_id").alias("section_id"), "note_id", F.col("title").alias("heading"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end"), "text")


ITEMS = [(i, f"d{i % 3}/Note{i}.md", f"alpha beta{i % 7} word{i} [[Note{(i + 1) % 40}]] #tag{i % 2}") for i in range(40)]


def rows(df):
    return sorted(map(repr, df.collect()))


def test_versions(spark):
    """A refresh writes what changed only; readers see the last version, or the one that they ask for; searches are those of tables."""
    before = notes(spark, ITEMS)
    first = build(spark, shared_path(spark, "index"), before, sections(before))
    assert first.version == 1 and first.refresh(before, sections(before)) is first
    changed = [x for x in ITEMS if x[0] != 5]
    changed[7] = (8, "d2/Note8.md", "gamma gamma alpha [[Note1]] [[Nowhere]]")
    after = notes(spark, [*changed, (99, "d9/New.md", "gamma [[Note8]]")])
    then = first.refresh(after, sections(after))
    assert (then.version, len(then.manifest["generations"]), then.manifest["generations"][1]["dead"]) == (2, 2, 2)
    assert then._table(then.manifest["generations"][1], "notes").count() == 2
    for held, df in ((open_index(spark, first.root), after), (open_index(spark, first.root, 1), before)):
        assert held.n_notes() == df.count()
        assert rows(held.postings()) == rows(search.terms(sections(df)).select("section_id", "note_id", "term", "term_count")) == rows(held.terms())
        assert rows(held.edges()) == rows(graph.edges(df)) and rows(held.tags()) == rows(graph.note_tags(df)) and rows(held.names()) == rows(graph.names(df))
        assert rows(held.unresolved()) == rows(graph.unresolved(df))
        told = search.Tables(sections(df), df.withColumn("status", F.lit(None).cast("string")))
        found = search.search(held, "gamma alpha beta3", 6)
        assert rows(found.select("rank", "section_id", "score", "matched_terms")) == rows(search.search(told, "gamma alpha beta3", 6).select("rank", "section_id", "score", "matched_terms"))
        s = held.statistics().first()
        assert (s.version, s.notes, s.sections, s.verified_edges) == (held.version, df.count(), df.count(), graph.edges(df).count())
    wide = then.discover(0.01)
    assert (wide.version, wide.statistics().first().candidate_edges) == (3, wide.candidates().count()) and wide.statistics().first().candidate_edges > 0
    with pytest.raises(ValueError, match="no candidates"):
        open_index(spark, first.root, 2).candidates()


def test_all_anew(spark, monkeypatch):
    """Beyond so many generations a refresh writes all notes; nothing is told twice."""
    monkeypatch.setattr(index, "MOST_GENERATIONS", 2)
    held = build(spark, shared_path(spark, "index"), notes(spark, ITEMS), sections(notes(spark, ITEMS)))
    for k in range(3):
        df = notes(spark, [(i, p, f"{t} round{k}" if i < 3 else t) for i, p, t in ITEMS])
        held = held.refresh(df, sections(df))
        assert len(held.manifest["generations"]) <= 2 and rows(held.terms()) == rows(search.terms(sections(df)).select("section_id", "note_id", "term", "term_count"))


def test_refusals(spark):
    root = shared_path(spark, "index")
    with pytest.raises(ValueError, match="no index"):
        open_index(spark, root)
    df = notes(spark, ITEMS[:3])
    held = build(spark, root, df, sections(df))
    with pytest.raises(ValueError, match="already"):
        build(spark, root, df, sections(df))
    with pytest.raises(ValueError, match="no version 7"):
        open_index(spark, root, 7)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def put(name, text):
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/manifests/{name}")
        out = path.getFileSystem(conf).create(path, False)
        out.write(bytearray(text.encode()))
        out.close()

    put("v00000002.json", '{"kind": "corkboard-index", "sch')  # a writer that died: the version isn't there
    assert open_index(spark, root).version == held.version
    put("v00000003.json", '{"kind": "other", "schema": 1, "version": 3}')
    with pytest.raises(ValueError, match="kind"):
        open_index(spark, root)


def test_empty(spark):
    df = notes(spark, ITEMS).limit(0)
    held = build(spark, shared_path(spark, "index"), df, sections(df))
    assert held.n_notes() == 0 and search.search(held, "alpha", 3).count() == 0 and held.edges().count() == 0
    more = notes(spark, ITEMS)
    assert held.refresh(more, sections(more)).n_notes() == 40


def test_buckets_are_pruned(spark, monkeypatch):
    """A search's scans read the buckets of its terms, and of its hits' ids, alone; a bucket of many rows is several files."""
    monkeypatch.setattr(index, "FILE_ROWS", 50)
    df = notes(spark, [(i, f"Note{i}.md", f"common word{i} other{i % 5}") for i in range(300)])
    held = build(spark, shared_path(spark, "index"), df, sections(df), buckets=16)

    conf = {"spark.sql.sources.bucketing.autoBucketedScan.enabled": "false", "spark.sql.files.maxPartitionBytes": "1m", "spark.sql.files.openCostInBytes": "1m"}

    def selected(frame):
        plan = spark._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "formatted")
        return [part.split(",")[0].split("\n")[0] for part in plan.split("SelectedBucketsCount: ")[1:]]

    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert selected(held.postings(["word7"])) == ["1 out of 16"] and held.postings(["word7"]).count() == 1
        assert selected(held.sections([3])) == ["1 out of 16"] and selected(held.notes([3])) == ["1 out of 16"]
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "true")  # a task a file: files of other buckets aren't read either
        assert held.postings(["word7"]).rdd.getNumPartitions() == 1 < held.postings(["common"]).rdd.getNumPartitions() < held.postings().rdd.getNumPartitions()
    finally:
        for k in conf:
            spark.conf.unset(k)
    files = [f for f in held.live("by_term").inputFiles()]
    assert len(files) > 16 and held.postings(["common"]).count() == 300
    assert "Exchange" not in held.terms().groupBy("note_id").agg(F.sum("term_count"))._jdf.queryExecution().executedPlan().toString()


def test_discovery_in_ranges(spark, monkeypatch):
    """Pairs are those of whole lists however postings are numbered; scores those of looked-up vectors however they join."""
    texts = [(i * 3 + i % 2, f"Note{i}.md", " ".join(f"w{(i * k) % 61}x" for k in range(1, 9))) for i in range(120)]
    df = notes(spark, texts)
    vectors = discovery.vectors(search.terms(sections(df)), 120)
    pairs, found = rows(discovery.pairs(vectors)), rows(discovery.candidates(vectors, 0.05, 3))
    assert len(pairs) > 500 and len(found) > 100
    monkeypatch.setattr(discovery, "RANGE_NOTES", 17)
    assert rows(discovery.pairs(vectors)) == pairs
    monkeypatch.setattr(discovery, "BROADCAST_BYTES", 0)
    assert rows(discovery.candidates(vectors, 0.05, 3)) == found
    none = vectors.limit(0)
    assert discovery.candidates(none, 0.1).count() == 0


def test_no_table_of_texts_or_pairs_moves(spark, monkeypatch):
    """Frequencies and the terms of sections are had without a shuffle, and what a build has staged is gone after it."""
    df = notes(spark, ITEMS)
    staged = set()
    monkeypatch.setattr(index, "stored", lambda d, name, put=index.stored: staged.add(out := put(d, name)) or out)
    held = build(spark, shared_path(spark, "index"), df, sections(df))
    gone = [t for t in staged if not {os.path.exists(f.removeprefix("file:")) for f in t.inputFiles()} - {False}]
    assert len(gone) >= 4  # terms, links, notes, names

    def plan(frame):
        return frame._jdf.queryExecution().executedPlan().toString()

    assert "Exchange" not in plan(search.packed(sections(df))) and rows(search.packed(sections(df)).select("section_id", "note_id", F.inline("terms"))) == rows(search.terms(sections(df)).select("section_id", "note_id", "term", "term_count"))
    assert "Exchange" not in plan(search.frequency(held.postings())) and rows(search.frequency(held.postings())) == rows(search.frequency(held.terms()))


def test_scoring_moves_no_vector_for_each_pair(spark, monkeypatch):
    """A block of vectors after another gives the same candidates and evidence, and pairs meet vectors of one side alone."""
    texts = [(i, f"Note{i}.md", " ".join(f"w{(i * k) % 61}x" for k in range(1, 9))) for i in range(200)]
    df = notes(spark, texts)
    vectors = discovery.vectors(search.terms(sections(df)), 200)
    found = discovery.candidates(vectors, 0.05, 3)
    told = rows(found), rows(discovery.ranked_terms(found, vectors))
    monkeypatch.setattr(discovery, "BROADCAST_BYTES", 0)
    joined = []
    near = discovery._near
    monkeypatch.setattr(discovery, "_near", lambda *a: joined.append(a[1:]) or near(*a))
    found = discovery.candidates(vectors, 0.05, 3)
    assert (rows(found), rows(discovery.ranked_terms(found, vectors))) == told and joined == [(0, 50), (50, 100), (100, 150), (150, 200)]


def test_candidates_of_all_pairs(spark, monkeypatch):
    """Each note's best are those of all others, however far apart they stand in the lists of their terms, and whatever the blocks."""
    rng = random.Random(4)
    words = {i: sorted(rng.sample(range(48), 6)) for i in range(240)}
    df = notes(spark, [(i, f"Note{i}.md", " ".join(f"w{k}x" for k in w)) for i, w in words.items()])
    vectors = discovery.vectors(search.terms(sections(df)), 240)
    counts = Counter(k for w in words.values() for k in w)
    weight = {k: math.log(241 / (n + 1)) + 1 for k, n in counts.items() if 2 <= n <= 48}
    norm = {i: math.sqrt(sum(weight.get(k, 0) ** 2 for k in w)) for i, w in words.items()}
    best, of = set(), {}
    for i, mine in words.items():
        for j, other in words.items():
            both = [k for k in mine if k in other and k in weight]
            of[i, j] = (round(sum(weight[k] ** 2 for k in both) / (norm[i] * norm[j]), 9), len(both))
        near = [(of[i, j][0], j) for j in words if i != j and of[i, j][1] >= 2 and of[i, j][0] >= 0.4]
        best |= {(min(i, j), max(i, j)) for _, j in sorted(near, reverse=True)[:3]}
    want = [(l, r, of[l, r][1], pytest.approx(of[l, r][0], abs=1e-6)) for l, r in sorted(best)]

    def found(**how):
        return sorted((r.l, r.r, r.shared, r.score) for r in discovery.candidates(vectors, 0.4, 3, **how).collect())

    assert found(whole=True) == want != found()
    monkeypatch.setattr(discovery, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(discovery, "TASK_NOTES", 50)
    assert found(whole=True) == want
    assert discovery.candidates(vectors.limit(0), 0.4, whole=True).count() == 0 and discovery.candidates(vectors, 0.4, 0, whole=True).count() == 0
