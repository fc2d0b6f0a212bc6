"""Graph documents written and read again, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corkboard.operators import document, graph
from corkboard.plans.queries import _CANDIDATE_STEPS, _EDGES, _LINKED_TERMS, THRESHOLD, query
from corkboard.sources import corpus, vault


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, documents) of a document a nation: the nation, its customers and suppliers, and the links that they have; every
    fifth document has its nation's node twice, every third summaries. Their histories are against nodes of which some were
    missing and some had other contents; every eighth has none before it."""
    held = corpus.linked_index(spark, sf_dir)
    customer, supplier = corpus.table(spark, sf_dir, "customer"), corpus.table(spark, sf_dir, "supplier")
    own = customer.select((F.col("c_custkey") + 1_000_000_000).alias("note_id"), F.col("c_nationkey").alias("document")).unionByName(supplier.select((F.col("s_suppkey") + 1_000_000).alias("note_id"), F.col("s_nationkey").alias("document")))
    own = own.unionByName(corpus.table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("note_id"), F.col("n_nationkey").alias("document")))
    notes = held.notes().join(own, "note_id")
    copies = F.when((F.col("document") % 5 == 0) & (F.col("domain") == "nation"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    empty = F.array().cast("array<string>")
    nodes = notes.withColumn("copy", F.explode(copies)).select(
        "document", (F.col("note_id") * 2 + F.col("copy")).alias("position"), F.col("path").alias("id"), "title", "path", F.lit("").alias("status"), "domain", F.when(F.col("document") % 3 == 0, F.concat(F.lit("Of "), "title")).otherwise("").alias("summary"),
        empty.alias("tags"), F.lit(1).cast("long").alias("section_count"), F.lit("2024-01-01T00:00:00Z").alias("created_at"), F.lit(None).cast("string").alias("modified_at"), "content_hash",
    )
    named = held.notes().select("note_id", "path")
    met = held.edges().join(own.withColumnRenamed("note_id", "source_id"), "source_id").join(named.select(F.col("note_id").alias("source_id"), F.col("path").alias("source")), "source_id").join(named.select(F.col("note_id").alias("target_id"), F.col("path").alias("target")), "target_id")
    side = F.lit(None).cast(document.SIDE)
    evidence = F.struct(empty.alias("shared_terms"), F.lit(None).cast("string").alias("source_text"), F.lit(None).cast("string").alias("explanation"), side.alias("source_evidence"), side.alias("target_evidence"))
    edges = met.select("document", (F.col("source_id") * 100 + F.col("line") * 10 + F.col("place")).alias("position"), F.concat_ws("-", "source", "kind", "target").alias("id"), "source", "target", "kind", F.lit(True).alias("verified"), F.lit(1.0).alias("score"), evidence.alias("evidence"))
    k = F.col("position") / 2
    before = nodes.filter((F.col("position") % 2 == 0) & (k % 13 != 0) & (F.col("document") % 8 != 0)).withColumn("content_hash", F.when(k % 17 == 0, F.sha2("id", 256)).otherwise(F.col("content_hash")))
    told = document.history(before.select("document", "id", "content_hash"), nodes.select("document", "id", "content_hash").distinct())
    given = F.struct(F.concat(F.lit("export-"), F.col("document").cast("string")).alias("export_id"), *[c for c in told.columns if c != "document"]).alias("history")
    heads = told.select("document", F.concat(F.lit("Nation "), F.col("document").cast("string")).alias("title"), F.lit("2024-01-02T00:00:00+01:00").alias("generated_at"), given)
    return nodes, edges, heads


_DOCUMENTS = f"""{_EDGES}, own AS (SELECT 1000000000 + c_custkey AS note_id, c_nationkey AS d FROM customer UNION ALL SELECT 1000000 + s_suppkey, s_nationkey FROM supplier UNION ALL SELECT 100 + n_nationkey, n_nationkey FROM nation),
nd AS (SELECT d, count(*) AS n FROM own GROUP BY d), ed AS (SELECT s.d, count(*) AS n, count(*) FILTER (t.d IS NULL) AS dangling FROM e JOIN own s ON s.note_id = source_id LEFT JOIN own t ON t.note_id = target_id AND t.d = s.d GROUP BY s.d),
k AS (SELECT nd.d, nd.n, coalesce(ed.n, 0) AS e, coalesce(dangling, 0) AS dangling, nd.d % 7 = 3 OR nd.d % 9 = 4 AS refused, CASE WHEN nd.d % 7 = 3 THEN 'unsupported_version' WHEN nd.d % 9 = 4 THEN 'not_json' END AS refusal FROM nd LEFT JOIN ed ON ed.d = nd.d)"""


@query(f"""WITH {_DOCUMENTS} SELECT d AS document, refusal, CASE WHEN refused THEN 0 ELSE n END AS n_nodes, CASE WHEN refused THEN 0 ELSE e - dangling END AS n_edges, CAST(NOT refused AND d % 5 = 0 AS BIGINT) AS duplicate_nodes, CASE WHEN refused THEN 0 ELSE dangling END AS dangling_edges,
CAST(0 AS BIGINT) AS duplicate_edges, CASE WHEN refused THEN NULL WHEN d % 3 = 0 THEN 'graph_with_bounded_passage_text' ELSE 'graph_metadata' END AS export_profile, NOT refused AND d % 4 = 1 AS privacy_conflict, NOT refused AND d % 6 = 2 AS history_conflict, NOT refused AND d % 6 <> 2 AND d % 5 <> 0 AS usable FROM k""")
def graph_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSON, some of them tampered with, and read again: what each has, and which claims don't hold. A nation's has
    all its nodes and edges, beyond a viewer's limits too."""
    written = document.documents(*_graph(spark, sf_dir), limited=False)
    d, text = F.col("document"), F.col("text")
    text = F.when(d % 4 == 1, F.regexp_replace(text, '"export_profile":"[a-z_]+"', '"export_profile":"empty_graph"')).otherwise(text)
    text = F.when(d % 6 == 2, F.regexp_replace(text, '"nodes_added":[0-9]+', '"nodes_added":777777')).otherwise(text)
    text = F.when(d % 7 == 3, F.replace(text, F.lit(document.VERSIONS[1]), F.lit("viewer.v9"))).when(d % 9 == 4, F.substring(text, 1, 100)).otherwise(text)
    return document.read(written.select("document", text.alias("text")), limited=False).documents


@query(f"""WITH {_DOCUMENTS}, nw AS (SELECT own.note_id, d, sha256(g.text) AS now FROM own JOIN g USING (note_id)), w AS (SELECT *, note_id % 13 <> 0 AND d % 8 <> 0 AS there, CASE WHEN note_id % 17 = 0 THEN 'x' ELSE now END AS was FROM nw)
SELECT d AS document, count(*) FILTER (there AND was <> now) AS node_content_hashes_changed, count(*) FILTER (there AND was = now) AS node_content_hashes_unchanged, count(*) FILTER (NOT there) AS nodes_added, CAST(0 AS BIGINT) AS nodes_removed, max(there) AS has_previous FROM w GROUP BY d""")
def document_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each document differs from the one before."""
    h = F.col("history")
    counts = ["node_content_hashes_changed", "node_content_hashes_unchanged", "nodes_added", "nodes_removed"]
    return _graph(spark, sf_dir)[2].select("document", *[h[c].alias(c) for c in counts], h["previous_content_hash"].isNotNull().alias("has_previous"))


# ---- admission ------------------------------------------------------------------------------------------------------------

POLICY = vault.Policy(exclude_globs=["suppliers/*7.MD"], deny_path_terms=["nation_1"], deny_frontmatter={"aliases": ["firm 6"]}, max_file_bytes=90)
_ADMITTED = f"""{_EDGES}, f AS (SELECT g.path AS relative_path, title, domain, o, CASE WHEN note_id > 1000000000 AND note_id % 89 = 0 THEN 'unended' WHEN note_id > 1000000000 AND note_id % 97 = 0 THEN 'utf16' ELSE 'whole' END AS kind,
  strlen(text) + CASE WHEN note_id > 1000000000 AND note_id % 89 = 0 THEN 4 WHEN note_id > 1000000000 AND note_id % 97 = 0 THEN 2 ELSE 0 END AS size, note_id FROM g),
a AS (SELECT *, CASE WHEN size > 90 THEN 'file_too_large' WHEN relative_path LIKE 'suppliers/%7.md' THEN 'excluded_glob' WHEN contains(lower(relative_path), 'nation_1') THEN 'denied_path_term' WHEN kind = 'utf16' THEN 'unsupported_encoding' WHEN kind = 'unended' THEN 'unparseable_frontmatter'
  WHEN domain = 'supplier' AND note_id = 1000006 THEN 'denied_frontmatter:aliases' END AS skip_reason FROM f)"""


def _admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The linked notes as files; some customers' begin with a byte order mark of another encoding, or with frontmatter that doesn't end."""
    key = F.col("note_id")
    customer = F.col("domain") == "customer"
    plain = F.encode("text", "UTF-8")
    content = F.when(customer & (key % 89 == 0), F.concat(F.encode(F.lit("---\n"), "UTF-8"), plain)).when(customer & (key % 97 == 0), F.concat(F.unhex(F.lit("FFFE")), plain)).otherwise(plain)
    files = corpus.linked_notes(spark, sf_dir).select(F.col("path").alias("relative_path"), content.alias("content"))
    files = files.select("relative_path", F.octet_length("content").cast("long").alias("size"), F.lit(0).cast("long").alias("mtime_ns"), "content", F.lit(None).cast("string").alias("skip_reason"))
    return vault.admitted(files, POLICY)


@query(f"WITH {_ADMITTED} SELECT relative_path, skip_reason, CASE WHEN skip_reason IS NULL THEN title END AS title, CASE WHEN skip_reason IS NULL THEN CASE WHEN domain = 'region' THEN 0 ELSE 1 END END AS sections, CASE WHEN skip_reason IS NULL THEN o END AS body_start FROM a")
def admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files through a policy of paths, sizes and frontmatter: the first reason against each, and what was parsed of the others."""
    found = _admitted(spark, sf_dir)
    kept = F.col("skip_reason").isNull()
    return found.select("relative_path", "skip_reason", F.when(kept, F.col("title")).alias("title"), F.when(kept, F.size("sections")).alias("sections"), F.when(kept, F.col("body_start")).alias("body_start"))


@query(f"WITH {_ADMITTED} SELECT skip_reason, count(*) AS files FROM a WHERE skip_reason IS NOT NULL GROUP BY skip_reason")
def admission_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files were left out, by reason."""
    return vault.skips(_admitted(spark, sf_dir))


# ---- candidates beside authored edges ---------------------------------------------------------------------------------------

_BOTH = f"""{_LINKED_TERMS}, {_CANDIDATE_STEPS}, al AS (SELECT source_id, target_id, kind, true AS is_verified, CAST(1.0 AS DOUBLE) AS score, line, place FROM e UNION ALL SELECT l, r, 'candidate', false, score, 0, 0 FROM cand),
near AS (SELECT * FROM al WHERE source_id IN (SELECT note_id FROM g WHERE domain = 'supplier' AND note_id % 5 = 0) OR target_id IN (SELECT note_id FROM g WHERE domain = 'supplier' AND note_id % 5 = 0))"""


@query(f"WITH {_BOTH} SELECT source_id, target_id, kind, is_verified, score, line, place, count(*) OVER () AS total, count(*) OVER () > 150 AS truncated FROM near ORDER BY is_verified DESC, score DESC, source_id, line, place, target_id LIMIT 150")
def edges_with_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At every fifth supplier: authored edges first, then candidates by score."""
    held = corpus.linked_index(spark, sf_dir).discover(THRESHOLD)
    return graph.incident(graph.all_edges(held.edges(), held.candidates()), _seeds(held), 150)


@query(f"WITH {_BOTH} SELECT source_id, target_id, kind, line, place, count(*) OVER () AS total FROM near WHERE is_verified")
def verified_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without candidates, though the index has some."""
    held = corpus.linked_index(spark, sf_dir).discover(THRESHOLD)
    edges = graph.all_edges(held.edges(), held.candidates()).filter("is_verified")
    return graph.incident(edges, _seeds(held), 1_000_000).select("source_id", "target_id", "kind", "line", "place", "total")


def _seeds(held) -> DataFrame:
    return held.notes().filter("domain = 'supplier' AND note_id % 5 = 0").select("note_id")
