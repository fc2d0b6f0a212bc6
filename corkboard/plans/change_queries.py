"""Renames, proposals, derived links and covered paths, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corkboard.functions.storage import shared_path
from corkboard.operators import changes, contract, gate, graph, index, proposals, sections
from corkboard.plans.queries import _EDGES, query
from corkboard.sources import corpus, registry

#: The linked notes before and after: `cur` has every file that there is now; `ren` what is renamed, and the text that links get.
_EDITED = f"""{_EDGES}, nt AS (SELECT 100 + n_nationkey AS id, n_nationkey AS k, 'nations/' || n_name || '.md' AS old_path, n_name, r_name FROM placed WHERE n_nationkey % 3 = 0),
ren AS (SELECT id, old_path, CASE WHEN k % 6 = 0 THEN 'lands/New ' || n_name || '.md' ELSE 'lands/' || k || '/' || r_name || '.md' END AS new_path, CASE WHEN k % 6 = 0 THEN 'New ' || n_name ELSE 'lands/' || k || '/' || r_name END AS link FROM nt WHERE k NOT IN (12, 18)
  UNION ALL SELECT 1, 'regions/' || r_name || '.md', 'areas/New ' || r_name || '.md', 'New ' || r_name FROM region WHERE r_regionkey = 1),
moved AS (SELECT id, new_path FROM ren UNION ALL SELECT id, 'lands/New ' || n_name || '.md' FROM nt WHERE k = 12 UNION ALL SELECT id, 'copies/' || n_name || '.md' FROM nt WHERE k = 12 UNION ALL SELECT id, NULL FROM nt WHERE k = 18),
cur AS (SELECT coalesce(new_path, path) AS path, CASE WHEN domain = 'customer' AND note_id % 50 = 0 THEN text || chr(10) || 'edited' WHEN domain = 'supplier' AND note_id % 8 = 0 THEN 'Moved' || chr(10) || text ELSE text END AS text
  FROM g LEFT JOIN moved ON id = note_id WHERE id IS NULL OR new_path IS NOT NULL),
ch AS (SELECT coalesce(g.path, cur.path) AS path, CASE WHEN g.path IS NULL THEN 'added' WHEN cur.path IS NULL THEN 'removed' ELSE 'modified' END AS change, sha256(g.text) AS old_hash, sha256(cur.text) AS new_hash FROM g FULL JOIN cur ON g.path = cur.path WHERE sha256(g.text) IS DISTINCT FROM sha256(cur.text)),
ed AS (SELECT old_path, new_path, r.path AS referrer, e.kind, e.line, sha256(r.text) AS precondition_hash, r.text,
  CASE WHEN r.path IN (SELECT path FROM ch) THEN 'content_hash_drift' WHEN r.domain = 'nation' AND r.note_id % 5 = 0 THEN 'multiple_occurrences_manual_review' WHEN e.kind = 'markdown_link' AND r.domain = 'supplier' THEN 'target_not_path_form' END AS reason,
  CASE WHEN e.kind = 'wikilink' AND r.domain = 'supplier' THEN '[[' || target_text || '|home]]' WHEN e.kind = 'wikilink' THEN '[[' || target_text || ']]' ELSE '[its region](' || target_text || ')' END AS old_text,
  CASE WHEN e.kind = 'wikilink' AND r.domain = 'supplier' THEN '[[' || link || '|home]]' WHEN e.kind = 'wikilink' THEN '[[' || link || ']]' ELSE '[its region](' || new_path || ')' END AS new_text FROM e JOIN ren ON e.target_id = id JOIN g r ON r.note_id = source_id),
edits AS (SELECT old_path, new_path, referrer, kind, line, reason, precondition_hash, CASE WHEN reason IS NULL THEN old_text END AS old_text, CASE WHEN reason IS NULL THEN new_text END AS replacement_text, CASE WHEN reason IS NULL THEN sha256(replace(text, old_text, new_text)) END AS predicted_hash FROM ed)"""


def _edited(spark: SparkSession, sf_dir: str) -> tuple:
    """(index, notes with their hashes, files, changes, edits of renames) of the linked notes before and after."""
    held = corpus.linked_index(spark, sf_dir)
    notes, files = held.notes(), corpus.edited_files(spark, sf_dir)
    found = changes.diff(notes, files.select("path", F.sha2("content", 256).alias("content_hash")))
    return held, notes, files, found, proposals.rename_edits(changes.renames(found), held.edges(), notes, files)


@query(f"WITH {_EDITED} SELECT * FROM edits")
def rename_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to renamed notes, rewritten, or why not."""
    return _edited(spark, sf_dir)[4]


def _digest_sql(name: str, rows: str) -> str:
    """name(path, digest, n): digests of two levels of rows (path, x)."""
    return f"""{name}_r AS (SELECT path, substr(x, 1, 4) AS range, count(*) AS n, sha256(string_agg(x, chr(10) ORDER BY x)) AS d FROM (SELECT DISTINCT path, sha256(value) AS x FROM ({rows})) GROUP BY ALL),
{name} AS (SELECT path, sum(n) AS n, sha256(string_agg(d, chr(10) ORDER BY range)) AS digest FROM {name}_r GROUP BY path)"""


def _proposal_sql(action: str, relation: str, path: str = "path") -> str:
    return f"'prp-' || substr(sha256('vault' || chr(0) || '{relation}' || chr(0) || {path} || chr(0) || '{action}' || chr(0) || digest), 1, 16) AS proposal_id, 'vault' AS source, '{action}' AS action, '{relation}' AS relation, {path} AS path"


_PROPOSALS = f"""{_EDITED}, ok AS (SELECT * FROM edits WHERE reason IS NULL),
{_digest_sql("d1", "SELECT old_path AS path, unnest([old_path, new_path, precondition_hash, predicted_hash]) AS value FROM ok")},
inb AS (SELECT t.path, s.path AS other FROM e JOIN g t ON t.note_id = target_id JOIN g s ON s.note_id = source_id WHERE t.path IN (SELECT path FROM ch WHERE change = 'removed') AND t.path NOT IN (SELECT old_path FROM ok)),
{_digest_sql("d2", "SELECT path, other AS value FROM inb")},
sec AS (SELECT path, o + 2 AS a, 1 + length(text) - length(replace(text, chr(10), '')) AS z, domain FROM g WHERE domain <> 'region'),
br AS (SELECT path, path || ':' || a || '-' || z AS value FROM sec JOIN ch USING (path) WHERE change = 'removed' OR (change = 'modified' AND domain = 'supplier')),
{_digest_sql("d3", "SELECT path, value FROM br")},
mem AS (SELECT h, path, max(changed) AS changed FROM (SELECT new_hash AS h, path, true AS changed FROM ch WHERE change <> 'removed' UNION ALL SELECT sha256(text), path, false FROM g) GROUP BY h, path),
grp AS (SELECT h FROM mem GROUP BY h HAVING count(*) > 1 AND max(changed)),
{_digest_sql("d4", "SELECT h AS path, mem.path AS value FROM mem WHERE h IN (SELECT h FROM grp)")},
props AS (SELECT {_proposal_sql("fix_links_after_rename", "DELETED")}, count(*) AS edits, count(DISTINCT referrer) AS grounds FROM ok JOIN d1 ON path = old_path GROUP BY path, digest
UNION ALL SELECT {_proposal_sql("review_dangling_references", "DELETED")}, 0, count(*) FROM inb JOIN d2 USING (path) GROUP BY path, digest
UNION ALL SELECT {_proposal_sql("review_broken_citations", "CITATION_BROKEN")}, 0, count(*) FROM br JOIN d3 USING (path) GROUP BY path, digest
UNION ALL SELECT {_proposal_sql("review_duplicates", "DUPLICATES_EXACT_BYTES", "mem.path")}, 0, CAST(n - 1 AS BIGINT) FROM mem JOIN d4 ON d4.path = h WHERE changed)"""


def _proposed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    held, notes, files, found, edits = _edited(spark, sf_dir)
    assessed = changes.assessed(found, notes)
    inbound = held.edges().join(notes.select(F.col("note_id").alias("target_id"), "path"), "target_id").join(notes.select(F.col("note_id").alias("source_id"), F.col("path").alias("other_path")), "source_id")
    broken = proposals.broken_in(assessed, held.sections().join(notes.select("note_id", "path"), "note_id"), files)
    return proposals.proposals("vault", assessed, edits, inbound, broken, changes.duplicate_members(found, notes)), edits


@query(f"WITH {_PROPOSALS} SELECT * FROM props")
def proposed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is proposed after notes were renamed, copied, removed and edited."""
    return _proposed(spark, sf_dir)[0]


@query(f"WITH {_PROPOSALS}, p AS (SELECT DISTINCT referrer AS path, proposal_id FROM ok JOIN props ON props.path = old_path AND action = 'fix_links_after_rename') SELECT 'vault' AS source, path, string_agg(proposal_id, ' ' ORDER BY proposal_id) AS proposals FROM p GROUP BY path HAVING count(*) > 1")
def edit_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that edits of more than one proposal touch."""
    found, edits = _proposed(spark, sf_dir)
    fixes = found.filter("action = 'fix_links_after_rename'").select("source", F.col("path").alias("old_path"), "proposal_id")
    return changes.conflicts(edits.filter("reason IS NULL").join(fixes, "old_path").select("source", F.col("referrer").alias("path"), "proposal_id"))


# ---- authored links, derived again ------------------------------------------------------------------------------------


@query(f"""WITH {_EDGES}, c AS (SELECT source_id, target_id, kind, line, source_id % 8 AS m FROM e)
SELECT source_id, target_id, kind, CASE m WHEN 1 THEN line + 1 ELSE line END AS line, m, CASE WHEN m IN (1, 4, 5) THEN 'no_link' WHEN m = 2 THEN 'other_target' WHEN m = 3 THEN 'unknown_kind' WHEN m = 6 THEN 'self_link' WHEN m = 7 THEN 'score' END AS reason FROM c""")
def derived_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges as claims, seven of eight false in one point: the line, the target, the kind, the quoted line, what it names, an end,
    the score. All must be found, and no true one."""
    held = corpus.linked_index(spark, sf_dir)
    m = F.col("source_id") % 8
    claims = held.edges().select(
        "source_id", F.col("target_id").alias("t"), F.col("kind").alias("k"), m.alias("m"), F.when(m == 6, F.col("source_id")).when(m == 2, F.col("target_id") + 1).otherwise(F.col("target_id")).alias("target_id"),
        F.when(m == 3, "mention").otherwise(F.col("kind")).alias("kind"), F.lit(True).alias("is_verified"), F.when(m == 7, 0.5).otherwise(1.0).alias("score"), (F.col("line") + (m == 1).cast("int")).alias("line"),
        F.when(m == 4, F.concat("source_text", F.lit("."))).otherwise(F.col("source_text")).alias("source_text"), F.when(m == 5, F.concat("target_text", F.lit("x"))).otherwise(F.col("target_text")).alias("target_text"),
    )
    notes = held.notes()
    told = contract.authored_links_hold(claims, held.sections(), sections.headings(corpus.linked_notes(spark, sf_dir)), notes, held.names(), graph.paths(notes))
    return told.select("source_id", F.col("t").alias("target_id"), F.col("k").alias("kind"), "line", "m", "reason")


# ---- covered paths ------------------------------------------------------------------------------------------------------

#: Three batches over the documents: what the last one says of a path is looked for in a later snapshot, which lacks some and has some otherwise.
_COVERED = """ob AS (SELECT source, doc_id, 'doc_' || doc_id || '.md' AS path, b AS batch, CASE (doc_id + b) % 4 WHEN 0 THEN 'removed' WHEN 1 THEN 'added' ELSE 'modified' END AS change, CASE WHEN (doc_id + b) % 4 > 0 THEN sha256(coalesce(text, '') || b) END AS new_hash FROM documents, range(1, 4) t(b) WHERE doc_id % (b + 1) = 0),
la AS (SELECT * FROM ob QUALIFY row_number() OVER (PARTITION BY source, path ORDER BY batch DESC) = 1),
sn AS (SELECT source, 'doc_' || doc_id || '.md' AS path, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE sha256(coalesce(text, '') || CASE WHEN doc_id % 4 = 0 THEN 3 WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END || CASE WHEN doc_id % 11 = 0 THEN '!' ELSE '' END) END AS h FROM documents WHERE (doc_id + CASE WHEN doc_id % 4 = 0 THEN 3 WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END) % 4 > 0 OR doc_id % 17 = 0)"""


@query(f"""WITH {_COVERED} SELECT la.source, la.path, CASE WHEN change = 'removed' THEN 'absent' ELSE 'present:' || new_hash END AS state FROM la LEFT JOIN sn ON sn.source = la.source AND sn.path = la.path
WHERE doc_id % 10 <> 0 AND CASE WHEN change = 'removed' THEN sn.path IS NULL ELSE h = new_hash END""")
def covered_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the paths of three batches, those whose last state a later snapshot bears out."""
    docs = corpus.table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))
    each = docs.withColumn("batch", F.explode(F.array(*map(F.lit, (1, 2, 3))))).filter(F.col("doc_id") % (F.col("batch") + 1) == 0)
    k = (F.col("doc_id") + F.col("batch")) % 4
    batches = each.select("source", "path", "batch", F.when(k == 0, "removed").when(k == 1, "added").otherwise("modified").alias("change"), F.when(k > 0, F.sha2(F.concat("text", F.col("batch").cast("string")), 256)).alias("new_hash"))
    last = F.when(F.col("doc_id") % 4 == 0, 3).when(F.col("doc_id") % 3 == 0, 2).otherwise(1)
    now = F.sha2(F.concat("text", last.cast("string"), F.when(F.col("doc_id") % 11 == 0, "!").otherwise("")), 256)
    snapshot = docs.filter(((F.col("doc_id") + last) % 4 > 0) | (F.col("doc_id") % 17 == 0)).select("source", "path", F.when(F.col("doc_id") % 13 != 0, now).alias("content_hash"))
    return proposals.covered(batches, docs.filter("doc_id % 10 = 0").select("source", "path"), snapshot)


# ---- scans that see less than there is -------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT doc_id, source || '/' || doc_id % 7 || '/doc_' || doc_id || '.md' AS path, coalesce(text, '') AS text FROM documents),
b AS (SELECT path, sha256(text) AS was FROM p WHERE doc_id % 10 <> 3),
s AS (SELECT path, CASE WHEN doc_id % 19 > 0 THEN sha256(text || CASE WHEN doc_id % 10 = 5 THEN ' changed' ELSE '' END) END AS now FROM p WHERE doc_id % 10 <> 1 AND path NOT LIKE 'src3/%' AND path NOT LIKE 'src4/2/%'),
m AS (SELECT p.path, was, now, s.path IS NOT NULL AS met, doc_id % 23 = 0 AS gone FROM p LEFT JOIN b ON b.path = p.path LEFT JOIN s ON s.path = p.path),
a AS (SELECT *, CASE WHEN gone THEN NULL WHEN met AND now IS NULL OR NOT met AND (path LIKE 'src3/%' OR path LIKE 'src4/2/%') THEN was ELSE now END AS after FROM m)
SELECT path, CASE WHEN was IS NULL THEN 'added' WHEN after IS NULL THEN 'removed' ELSE 'modified' END AS change, was AS old_hash, after AS new_hash FROM a WHERE NOT gone AND was IS DISTINCT FROM after""")
def observed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of a scan in which two folders couldn't be listed, some files weren't read whole and some are no longer admitted."""
    docs = corpus.table(spark, sf_dir, "documents")
    key = F.col("doc_id")
    named = docs.select("doc_id", F.concat("source", F.lit("/"), (key % 7).cast("string"), F.lit("/doc_"), key.cast("string"), F.lit(".md")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    before = named.filter(key % 10 != 3).select("path", F.sha2("text", 256).alias("content_hash"))
    now = F.sha2(F.concat("text", F.when(key % 10 == 5, " changed").otherwise("")), 256)
    seen = named.filter((key % 10 != 1) & ~F.col("path").startswith("src3/") & ~F.col("path").startswith("src4/2/")).select("path", F.when(key % 19 > 0, now).alias("content_hash"))
    failed = spark.createDataFrame([("src3",), ("src4/2",), ("src4/20",)], "path string")
    return changes.observed(before, seen, failed, named.filter(key % 23 == 0).select("path"))[0]


# ---- gates ---------------------------------------------------------------------------------------------------------------


def _parts(notes: DataFrame) -> dict[str, DataFrame]:
    """Headings and sections of notes (path, text), by their place."""
    read = sections.read(notes.select("path", "text"))
    return {"heading": read.select("path", F.posexplode("p.headings").alias("ordinal", "h")).select("path", "ordinal", "h.*"), "section": read.select("path", F.posexplode("p.sections").alias("ordinal", "s")).select("path", "ordinal", "s.heading", "s.line_start", "s.line_end")}


@query(f"""WITH {_EDGES}, x AS (SELECT path, domain, note_id FROM g WHERE (domain = 'customer' AND note_id % 100 = 0) OR (domain = 'supplier' AND note_id % 8 = 0))
SELECT path, 'fix_unresolved_link' AS mutation_class, part, ordinal, reason FROM x, (VALUES ('heading', 0, 'changed', 'supplier'), ('section', 0, 'changed', 'supplier'), ('section', 1, 'added', 'supplier'), ('section', 0, 'changed', 'customer')) v(part, ordinal, reason, d) WHERE d = domain""")
def structure_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits that shifted what they had to keep: a line put before suppliers' headings, a section made longer by what should have kept
    its lines. Lines appended at a note's end are no violation."""
    notes = corpus.linked_notes(spark, sf_dir)
    key = F.col("note_id")
    touched = notes.filter(((F.col("domain") == "customer") & (key % 50 == 0)) | ((F.col("domain") == "supplier") & (key % 8 == 0)))
    edits = touched.select("path", F.when((F.col("domain") == "supplier") | (key % 100 == 0), "fix_unresolved_link").otherwise("append_at_eof").alias("mutation_class"))
    after = corpus.edited_files(spark, sf_dir).select("path", F.col("content").cast("string").alias("text"))
    return gate.structure(edits, _parts(notes), _parts(after.join(edits.select("path"), "path", "left_semi")))


_AFTER = "NOT (domain = 'customer' AND (note_id - 1000000000) % 11 = 0)"
_REFRESHED = f"""{_EDGES}, g2 AS (SELECT * FROM g WHERE {_AFTER}), e2 AS (SELECT e.* FROM e JOIN g2 ON note_id = source_id), t2 AS (SELECT tg.* FROM tg JOIN g2 USING (note_id)), u2 AS (SELECT lk.* FROM lk JOIN g2 USING (note_id) WHERE reason IS NOT NULL)"""


def _refreshed(spark: SparkSession, sf_dir: str) -> tuple[index.Index, index.Index]:
    """An index without some customers and with others' and all suppliers' old texts, and its next version: some customers are gone,
    the others there and as they are."""
    now = corpus.linked_notes(spark, sf_dir)
    key = F.col("note_id") - 1_000_000_000
    was = now.filter((F.col("domain") != "customer") | (key % 9 != 0)).withColumn("text", F.when(F.col("domain") == "supplier", F.concat(F.lit("# Old\n[[Nowhere]] #old "), "title")).when((F.col("domain") == "customer") & (key % 8 == 0), F.lit("old")).otherwise(F.col("text")))
    after = now.filter((F.col("domain") != "customer") | (key % 11 != 0))

    def parts(notes: DataFrame) -> DataFrame:
        return sections.sections(notes).withColumn("section_id", F.col("note_id") * 16 + F.col("ordinal"))

    first = index.build(spark, shared_path(spark, "index-versions"), was, parts(was))
    return first, first.refresh(after, parts(after))


@query(f"""WITH {_REFRESHED} SELECT 2 AS version, (SELECT count(*) FROM g2) AS notes, (SELECT count(*) FROM g2 WHERE domain <> 'region') AS sections, (SELECT count(*) FROM e2) AS verified_edges, CAST(0 AS BIGINT) AS candidate_edges,
(SELECT count(*) FROM t2) AS note_tags, (SELECT count(*) FROM u2) AS unresolved_links""")
def index_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index's counts after a refresh that read only what had changed."""
    return _refreshed(spark, sf_dir)[1].statistics().drop("indexed_at")


@query(f"""WITH {_REFRESHED}, c AS (SELECT count(*) AS n FROM customer WHERE c_custkey % 9 <> 0), s AS (SELECT count(*) AS n FROM supplier),
old AS (SELECT (SELECT count(*) FROM g WHERE domain <> 'customer') + c.n AS notes, (SELECT count(*) FROM lk JOIN g USING (note_id) WHERE reason IS NOT NULL AND domain <> 'supplier') + s.n AS unresolved_links,
  (SELECT count(*) FROM e JOIN g ON note_id = source_id WHERE domain NOT IN ('supplier', 'customer')) + (SELECT count(*) FROM e JOIN customer ON source_id = 1000000000 + c_custkey WHERE c_custkey % 9 <> 0 AND c_custkey % 8 <> 0 AND kind = 'wikilink' AND target_id < 1000000) AS edges,
  (SELECT count(*) FROM customer WHERE c_custkey % 9 <> 0 AND c_custkey % 8 <> 0 AND c_custkey % 20 = 0) AS lost FROM c, s),
d AS (SELECT 'notes' AS counter, (SELECT count(*) FROM g2) - notes AS delta FROM old UNION ALL SELECT 'unresolved_links', (SELECT count(*) FROM u2) - unresolved_links - lost FROM old UNION ALL SELECT 'verified_edges', (SELECT count(*) FROM e2) - edges FROM old),
k AS (SELECT (SELECT count(*) FROM customer WHERE c_custkey % 9 = 0 AND c_custkey % 11 <> 0) AS made, (SELECT count(*) FROM customer WHERE c_custkey % 11 = 0 AND c_custkey % 9 <> 0) AS gone, (SELECT count(*) FROM supplier) AS fixed)
SELECT counter, delta, CASE counter WHEN 'notes' THEN -gone WHEN 'unresolved_links' THEN -fixed ELSE 0 END AS low, CASE counter WHEN 'notes' THEN made WHEN 'verified_edges' THEN fixed ELSE 0 END AS high, delta BETWEEN CASE counter WHEN 'notes' THEN -gone WHEN 'unresolved_links' THEN -fixed ELSE 0 END AND CASE counter WHEN 'notes' THEN made WHEN 'verified_edges' THEN fixed ELSE 0 END AS within FROM d, k""")
def receipt_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the index's counters moved, and how far edits of these classes may move them."""
    first, then = _refreshed(spark, sf_dir)
    customers = corpus.linked_notes(spark, sf_dir).filter("domain = 'customer'").withColumn("k", F.col("note_id") - 1_000_000_000)
    made = F.when((F.col("k") % 9 == 0) & (F.col("k") % 11 != 0), "create_new_file").when((F.col("k") % 11 == 0) & (F.col("k") % 9 != 0), "move_to_trash")
    edits = customers.select(made.alias("mutation_class")).filter("mutation_class IS NOT NULL").unionByName(corpus.table(spark, sf_dir, "supplier").select(F.lit("fix_unresolved_link").alias("mutation_class")))
    return gate.receipts(edits, first.statistics(), then.statistics())


# ---- registries of sources -------------------------------------------------------------------------------------------------

_ENTRIES = """c AS (SELECT c_nationkey AS registry, c_custkey AS pos, CASE c_custkey % 17 WHEN 0 THEN NULL WHEN 1 THEN 'bad name' WHEN 2 THEN repeat('n', 129) || c_custkey WHEN 3 THEN 'Same' WHEN 4 THEN 'same' ELSE 'src-' || c_custkey END AS name,
  CASE WHEN c_custkey % 13 = 0 THEN 'socket' WHEN c_custkey % 7 = 0 THEN 'file' ELSE 'folder' END AS type, CASE WHEN c_custkey % 19 = 0 THEN 'write' WHEN c_custkey % 5 = 0 THEN 'appliable' ELSE 'read_only' END AS mode,
  CASE WHEN c_custkey % 23 = 0 THEN 'vault/here' WHEN c_custkey % 29 = 0 THEN 'https://there' WHEN c_custkey % 31 = 0 THEN '/vaults/' || c_mktsegment WHEN c_custkey % 3 = 0 THEN '/vaults/' || c_mktsegment || '/0' ELSE '/vaults/' || c_custkey % 40 || '/' || c_custkey END AS root,
  CASE WHEN c_custkey % 37 = 0 THEN NULL WHEN c_custkey % 41 = 0 THEN 'link' WHEN c_custkey % 7 = 0 THEN 'file' ELSE 'folder' END AS found, c_custkey % 2 = 0 AS listed FROM customer),
j AS (SELECT *, CASE WHEN name IS NULL THEN 'missing_key' WHEN contains(root, '://') THEN 'remote' WHEN name = 'bad name' THEN 'bad_name' WHEN length(name) > 128 THEN 'long_name' WHEN pos > min(pos) OVER (PARTITION BY registry, name) THEN 'duplicate_name'
  WHEN pos > min(pos) OVER (PARTITION BY registry, lower(name)) THEN 'name_collision' WHEN type = 'socket' THEN 'unknown_type' WHEN mode = 'write' THEN 'unknown_mode' WHEN root[1] <> '/' THEN 'relative_root' WHEN found = 'link' THEN 'root_is_link' WHEN found IS NULL THEN 'root_missing'
  WHEN type = 'file' AND found <> 'file' THEN 'root_not_file' WHEN type <> 'file' AND found <> 'folder' THEN 'root_not_folder' WHEN mode = 'appliable' AND NOT listed THEN 'no_allowlist' WHEN mode = 'appliable' AND type = 'file' THEN 'appliable_file' END AS reason FROM c),
o AS (SELECT a.registry, a.pos, count(*) AS n_over FROM j a JOIN j b ON a.registry = b.registry AND a.pos <> b.pos AND (a.root = b.root OR starts_with(a.root, b.root || '/') OR starts_with(b.root, a.root || '/')) WHERE a.reason IS NULL AND b.reason IS NULL GROUP BY ALL)"""


@query(f"WITH {_ENTRIES} SELECT j.registry, j.pos AS position, CASE WHEN n_over > 0 THEN 'overlapping_root' ELSE reason END AS reason, coalesce(n_over, 0) AS overlaps FROM j LEFT JOIN o ON o.registry = j.registry AND o.pos = j.pos")
def refused_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as entries of their nation's registry: which are refused, and why."""
    k = F.col("c_custkey")
    m, text = k % 17, k.cast("string")
    name = F.when(m == 0, None).when(m == 1, "bad name").when(m == 2, F.concat(F.repeat(F.lit("n"), F.lit(129)), text)).when(m == 3, "Same").when(m == 4, "same").otherwise(F.concat(F.lit("src-"), text))
    home = F.concat(F.lit("/vaults/"), "c_mktsegment")
    root = F.when(k % 23 == 0, "vault/here").when(k % 29 == 0, "https://there").when(k % 31 == 0, home).when(k % 3 == 0, F.concat(home, F.lit("/0"))).otherwise(F.concat(F.lit("/vaults/"), (k % 40).cast("string"), F.lit("/"), text))
    entries = corpus.table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("registry"), k.alias("position"), name.alias("name"), F.when(k % 13 == 0, "socket").when(k % 7 == 0, "file").otherwise("folder").alias("type"),
        F.when(k % 19 == 0, "write").when(k % 5 == 0, "appliable").otherwise("read_only").alias("mode"), root.alias("root"),
        F.when(k % 37 == 0, None).when(k % 41 == 0, "link").when(k % 7 == 0, "file").otherwise("folder").alias("found"), F.when(k % 2 == 0, F.array(F.lit("a.md"))).otherwise(F.array().cast("array<string>")).alias("include_paths"),
    )
    return registry.judged(entries).select("registry", "position", "reason", "overlaps")
