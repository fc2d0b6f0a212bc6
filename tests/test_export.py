"""Graph documents, sections of tables and streamed changes."""

import pytest

from corkboard.operators import export, sections
from corkboard.streaming import observe


def test_edge_context(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 4), (5, 4)], "source_id long, target_id long")
    tags = spark.createDataFrame([(1, "x"), (2, "x"), (2, "y"), (4, "y"), (1, "y")], "note_id long, tag string")
    rows = {(r.source_id, r.target_id): (r.mutual, r.mutual_total, r.shared_tags) for r in export.edge_context(edges, tags, most=1).collect()}
    assert rows == {(1, 2): ([3], 1, ["x"]), (2, 3): ([1], 1, []), (3, 1): ([2], 1, []), (1, 4): ([], 0, ["y"]), (5, 4): ([], 0, [])}


def test_import(spark):
    nodes = spark.createDataFrame([(0, "a", "A"), (1, "b", "B"), (2, "a", "again")], "position long, id string, title string")
    edges = spark.createDataFrame([(0, "e", "a", "z"), (1, "e", "a", "b"), (2, "e", "b", "a"), (3, None, "b", "a")], "position long, id string, source string, target string")
    n, e, counts = export.imported(nodes, edges)
    assert {(r.id, r.title) for r in n.collect()} == {("a", "A"), ("b", "B")}
    assert {(r.position, r.id) for r in e.collect()} == {(1, "e"), (3, "edge-4")}
    assert {r.reason: r.n for r in counts.collect()} == {"dangling_edge": 1, "duplicate_edge": 1, "duplicate_node": 1}
    with pytest.raises(Exception, match="no id: node"):
        export.imported(nodes.withColumn("id", nodes.id.substr(5, 1)), edges)[0].collect()


def test_covering(spark):
    notes = spark.createDataFrame([(1, "a.md", "top\n# H\n\nx\ny"), (2, "b.md", None)], "note_id long, path string, text string")
    s = sections.sections(notes)
    places = spark.createDataFrame([(1, 1), (1, 2), (1, 5), (2, 1)], "note_id long, line int")
    assert {(r.note_id, r.line): r.ordinal for r in sections.covering(places, s).collect()} == {(1, 1): 0, (1, 2): None, (1, 5): 1, (2, 1): None}


def test_follow(spark, tmp_path):
    into, schema = str(tmp_path / "in"), "path string, content_hash string, seq long"

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(into)
        q = observe.follow(spark.readStream.schema(schema).parquet(into), str(tmp_path / "t"), str(tmp_path / "c"))
        q.awaitTermination()
        assert q.exception() is None

    arrive([("a", "1", 1), ("b", "1", 1), ("c", "1", 1), ("c", "2", 2), ("d", "1", 1), ("d", None, 2)])
    arrive([("a", "1", 3), ("b", "3", 3), ("c", None, 3), ("e", "5", 3)])
    got = {(r.batch, r.path, r.change, r.old_hash, r.new_hash) for r in observe.changes(spark, str(tmp_path / "t")).collect()}
    assert got == {(0, p, "added", None, h) for p, h in (("a", "1"), ("b", "1"), ("c", "2"))} | {(1, "b", "modified", "1", "3"), (1, "c", "removed", "2", None), (1, "e", "added", None, "5")}


def test_follow_by_state(spark, tmp_path):
    """Ten batches give the changes that a comparison of whole snapshots gives, a batch that is run again after a failure too."""
    import random

    into, schema = str(tmp_path / "in"), "path string, content_hash string, seq long"
    rng, known, want, held = random.Random(3), set(), set(), {}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", observe.STATE_STORE)
    try:
        for n in range(10):
            rows = [(rng.choice("abcdefgh"), rng.choice(["1", "2", "3", None]), 10 * n + k) for k in range(rng.randint(1, 9))] + [(None, "x", 1)]
            last = {p: h for p, h, _ in rows if p}
            for p, h in last.items():
                if held.get(p) != h:
                    want.add((n, p, "added" if p not in held else "removed" if h is None else "modified", held.get(p), h))
                held = {**held, p: h} if h is not None else {k: v for k, v in held.items() if k != p}
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(into)
            stream = spark.readStream.schema(schema).parquet(into)
            if n == 4:  # the sink fails once, after the state was computed; the query starts again from its checkpoint

                def fail(batch, _):
                    batch.count()
                    raise RuntimeError("lost")

                broken = observe.changes_by_state(stream).writeStream.outputMode("append").foreachBatch(fail).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
                with pytest.raises(Exception, match="lost"):
                    broken.awaitTermination()
            q = observe.follow_by_state(stream, str(tmp_path / "t"), str(tmp_path / "c"))
            q.awaitTermination()
            assert q.exception() is None
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {(r.batch, r.path, r.change, r.old_hash, r.new_hash) for r in observe.changes(spark, str(tmp_path / "t")).collect()}
    assert got == want and len(want) > 20
